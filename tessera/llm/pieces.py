"""SentencePiece encoding and decoding: the N best segmentations of a text by its piece scores.

Forward Viterbi over the piece lattice gives the best score up to each place; a backward A* search
takes these as its heuristics, which are exact, so the first N complete paths it pops are the N best.

No piece of the vocabulary joins a non-blank to a following blank mark, and none holds a character
that is in no piece at all, so a text's lattice is a chain of word lattices (checked when the model
is loaded; otherwise a text is one word).  Viterbi runs once for each distinct word of a slice, for
all words together, forward and backward, which also tells each word's loss to its second best path.
The N best of a chain change at most the N - 1 words with the smallest such losses, so A* runs on
those words alone, and their alternatives are merged.  The memo of words is bounded.

A character without a piece of its own is spelled in byte pieces, at a score of ten below the lowest.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import mix
from tessera.llm.tokens import text_groups
from tessera.workers import kept, lean

MARK = "▁"
MEMO_LIMIT = 650_000
WIDE = 28  # longer words take the plain path, one at a time
LONG = 1000  # longer ones are not remembered


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        self.text_of: list[bytes] = [b""] * n
        self.byte_ids: list[int] = [lib.unk_id()] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.text_of[i] = i, bytes([value])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
                self.text_of[i] = piece.replace(MARK, " ").encode()
        self.text_size = np.array([len(x) for x in self.text_of], np.int32)
        self.text_first = (np.cumsum(self.text_size) - self.text_size).astype(np.int32)
        self.text_flat = np.frombuffer(b"".join(self.text_of), np.uint8)
        self.unknown = min(self.score.values(), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)
        self.prefix = lib.normalize("a").startswith(MARK)
        chars = set("".join(self.ids))
        apart = all(MARK not in p.lstrip(MARK) for p in self.ids)
        line = "" if "\n" in chars else "\\n"
        self.words = re.compile((r"\n|" if line else "") + rf"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+") if apart else re.compile(r"(?s).+")
        self._tables()
        self.memo: dict[str, tuple[float, float, bytes]] = {}
        self.old: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        own = kept("pieces")
        if path not in own:
            own[path] = cls(path)
        return own[path]

    def _tables(self) -> None:
        """Hashes of all prefixes of pieces, sorted, with the piece that each one is, or -1."""
        whole: dict[int, tuple[int, float]] = {}
        for piece, i in self.ids.items():
            h = 0
            for at, c in enumerate(piece):
                h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if at + 1 == len(piece):
                    whole[h] = (i, self.score[piece])
                else:
                    whole.setdefault(h, (-1, 0.0))
        keys = np.array(list(whole), np.uint64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.key_id = np.array([v[0] for v in whole.values()], np.int64)[by]
        self.key_score = np.array([v[1] for v in whole.values()], np.float64)[by]
        # an index by the top bits of a scrambled hash: most look-ups take one or two probes
        self.bits = 20
        scrambled = mix(self.keys) >> np.uint64(64 - self.bits)
        order = np.argsort(scrambled, kind="stable")
        self.keys, self.key_id, self.key_score, scrambled = self.keys[order], self.key_id[order], self.key_score[order], scrambled[order]
        self.slot = np.searchsorted(scrambled, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.probes = int(np.diff(self.slot).max(initial=1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash in the prefix table, or -1."""
        cell = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        low, high = self.slot[cell], self.slot[cell + 1]
        out = np.where((low < high) & (self.keys[np.minimum(low, len(self.keys) - 1)] == h), low, -1)
        more = np.flatnonzero((out < 0) & (high - low > 1))
        for i in range(1, self.probes):
            more = more[low[more] + i < high[more]]
            hit = more[self.keys[low[more] + i] == h[more]]
            out[hit] = low[hit] + i
        return out

    def spell(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()]

    # one word, plainly

    def arcs(self, word: str, end: int) -> list[tuple[int, float, list[int]]]:
        """(start, score, ids) of the pieces that end at ``end``."""
        out: list[tuple[int, float, list[int]]] = []
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            if piece in self.ids:
                out.append((start, self.score[piece], [self.ids[piece]]))
        if word[end - 1] not in self.ids:
            out.append((end - 1, self.unknown, self.spell(word[end - 1])))
        return out

    def nbest(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations: forward Viterbi, then backward A*.

        An open path's heuristic is exact, so each one stands for a best completion of its own and only as
        many of them as are still wanted need to stay open: memory is the word's length and n paths.
        """
        best = array("d", [0.0])
        for end in range(1, len(word) + 1):
            best.append(max(best[s] + w for s, w, _ in self.arcs(word, end)))
        heap, turn, out = [(-best[len(word)], 0, len(word), 0.0, None)], 1, []
        while heap and len(out) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((done, ids))
                continue
            for start, w, piece in self.arcs(word, at):
                heapq.heappush(heap, (-(best[start] + w + done), turn, start, w + done, (piece, path)))
                turn += 1
            if len(heap) > 8 * n + 64:
                heap = heapq.nsmallest(n - len(out), heap)
        return out

    def alternatives(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """(loss to the best, ids) of the n best of a word."""
        key = (word, n)
        if key in self.lists:
            return self.lists[key]
        found = self.nbest(word, n)
        out = [(found[0][0] - s, array("I", ids).tobytes()) for s, ids in found]
        if len(word) <= LONG:
            if len(self.lists) > MEMO_LIMIT // 4:
                self.lists.clear()
            self.lists[key] = out
        return out

    # many words at once

    def learn(self, words: Iterable[str]) -> None:
        """Memoise (best score, loss to the second best, best ids) of words."""
        wide = [w for w in words if len(w) > WIDE]
        for w in wide:
            found = self.nbest(w, 2)
            loss = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            self.memo[w] = (found[0][0], loss, array("I", found[0][1]).tobytes())
        slim = [w for w in words if len(w) <= WIDE]
        slim.sort(key=len)
        for at in range(0, len(slim), 4096):
            self._viterbi(slim[at : at + 4096])

    def _viterbi(self, words: list[str]) -> None:
        """Forward and backward Viterbi over the lattices of all words, longest first, in arrays
        [start, length - 1, word]: the words that reach a place are the first ones of each row."""
        words = sorted(words, key=len, reverse=True)
        n = len(words)
        if n == 0:
            return
        size = np.array([len(w) for w in words], np.int64)
        wide, most = int(size[0]), min(self.longest, int(size[0]))
        reach = [int(np.searchsorted(-size, -e, "right")) for e in range(wide + 2)]  # words of at least e characters
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(n), size)
        offset = np.arange(len(points)) - first[owner]
        room = size[owner] - offset
        score = np.full((wide, most, n), -np.inf)
        ident = np.zeros((wide, most, n), np.int32)
        h, live = np.zeros(len(points), np.uint64), np.arange(len(points))
        for m in range(most):
            live = live[room[live] > m]
            if len(live) == 0:
                break
            h[live] = h[live] * np.uint64(0x100000001B3) + points[live + m] + np.uint64(1)
            row = self._find(h[live])
            live, row = live[row >= 0], row[row >= 0]
            piece = self.key_id[row] >= 0
            at, got = live[piece], row[piece]
            score[offset[at], m, owner[at]] = self.key_score[got]
            ident[offset[at], m, owner[at]] = self.key_id[got]
        bare = np.isneginf(score[offset, 0, owner])
        score[offset[bare], 0, owner[bare]] = self.unknown
        ident[offset[bare], 0, owner[bare]] = -1 - points[bare].astype(np.int64)
        ahead, back = np.full((wide + 1, n), -np.inf), np.full((wide + 1, n), -np.inf)
        length = np.zeros((wide + 1, n), np.int64)
        ahead[0] = 0
        for e in range(1, wide + 1):
            k = reach[e]
            best, took = np.full(k, -np.inf), np.zeros(k, np.int64)
            for m in range(min(e, most), 0, -1):
                value = ahead[e - m, :k] + score[e - m, m - 1, :k]
                better = value > best
                np.copyto(best, value, where=better)
                np.copyto(took, m, where=better)
            ahead[e, :k], length[e, :k] = best, took
        back[size, np.arange(n)] = 0
        for s in range(wide - 1, -1, -1):
            k = reach[s + 1]
            best = np.full(k, -np.inf)
            for m in range(1, min(most, wide - s) + 1):
                np.maximum(best, back[s + m, :k] + score[s, m - 1, :k], out=best)
            back[s, :k] = best
        total = ahead[size, np.arange(n)]
        at, rows, paths = size.copy(), np.arange(n), []
        while len(rows):
            m = length[at[rows], rows]
            at[rows] -= m
            paths.append((rows, ident[at[rows], m - 1, rows]))
            score[at[rows], m - 1, rows] = -np.inf  # what is left beside the best path gives the second best
            rows = rows[at[rows] > 0]
        second = np.full(n, -np.inf)
        for s in range(wide):
            for m in range(1, min(most, wide - s) + 1):
                k = reach[s + m]
                np.maximum(second[:k], ahead[s, :k] + score[s, m - 1, :k] + back[s + m, :k], out=second[:k])
        rows = np.concatenate([r for r, _ in paths])
        steps = np.repeat(np.arange(len(paths)), [len(r) for r, _ in paths])
        order = np.argsort(rows * (len(paths) + 1) - steps, kind="stable")
        found = np.concatenate([i for _, i in paths])[order].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).tolist()
        plain = found.astype("<u4").tobytes()
        odd = set(rows[order][found < 0].tolist())
        for i, (w, t, loss) in enumerate(zip(words, total.tolist(), (total - second).tolist(), strict=True)):
            a, b = cut[i], cut[i + 1]
            ids = plain[4 * a : 4 * b] if i not in odd else array("I", [x for f in found[a:b].tolist() for x in ([f] if f >= 0 else self.spell(chr(-1 - f)))]).tobytes()
            self.memo[w] = (t, loss, ids)

    def encode(self, texts: list[str | None], n: int) -> list[list[tuple[float, bytes]]]:
        """For each text its n best (score, ids), best first; a null or empty text has the empty one."""
        cut = [self.words.findall(self.library.normalize(t)) if t else [] for t in texts]
        if len(self.memo) > MEMO_LIMIT:  # the memo becomes the old one; what is used again comes back
            self.memo, self.old = {}, self.memo
        found = [list(map(self.memo.get, words)) for words in cut]
        lacking = [i for i, rows in enumerate(found) if None in rows]
        new = {w for i in lacking for w, r in zip(cut[i], found[i], strict=True) if r is None}
        known = new.intersection(self.old)
        self.memo.update(zip(known, map(self.old.__getitem__, known), strict=True))
        self.learn(new.difference(known))
        for i in lacking:
            found[i] = list(map(self.memo.__getitem__, cut[i]))
        for w in new:
            if len(w) > LONG:
                del self.memo[w]
        return [self._combined(words, rows, n) for words, rows in zip(cut, found, strict=True)]

    def _combined(self, words: list[str], rows: list[tuple[float, float, bytes]], n: int) -> list[tuple[float, bytes]]:
        """The n best of a chain of words: only the n - 1 words with the smallest losses can differ."""
        if not rows:
            return [(0.0, b"")]
        scores, losses, ids = zip(*rows, strict=True)
        best, whole = math.fsum(scores), b"".join(ids)
        found: list[tuple[float, tuple]] = [(0.0, ())]
        weak = range(len(losses)) if len(losses) < n else sorted(np.argpartition(np.array(losses), n - 2)[: n - 1].tolist()) if n > 1 else ()
        for i in weak:
            if losses[i] < math.inf:
                found = sorted(((c + d, (*change, (i, alt)) if alt != ids[i] else change) for c, change in found for d, alt in self.alternatives(words[i], n)), key=lambda x: x[0])[:n]
        out = []
        for c, change in found:
            text, shift = whole, 0
            for i, alt in change:  # in the order of places
                at = len(b"".join(ids[:i])) + shift
                text = text[:at] + alt + text[at + len(ids[i]) :]
                shift += len(alt) - len(ids[i])
            out.append((best - c, text))
        return out

    def decode(self, found: list[bytes]) -> list[bytes]:
        """UTF-8 texts of lists of ids; the blank that normalization puts in front is taken off."""
        ids = np.frombuffer(b"".join(found), "<u4")
        size = self.text_size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        short = np.int32 if upto[-1] < 1 << 31 else np.int64
        place = np.repeat(self.text_first[ids].astype(short) - upto[:-1].astype(short), size)
        place += np.arange(int(upto[-1]), dtype=short)
        data = self.text_flat[place].tobytes()
        ends = upto[np.cumsum([len(x) // 4 for x in found])].tolist() if found else []
        out, at = [], 0
        for end in ends:
            skip = 1 if self.prefix and end > at and data[at] == 0x20 else 0
            out.append(data[at + skip : end])
            at = end
        return out


def nbest_segmentations(docs: DataFrame, model: str, n: int = 3, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids): up to n rows a document, best first, without a shuffle.

    ``ids`` are little-endian unsigned 32-bit; with ``decode`` a column ``text`` has what they decode to.
    A null or empty text has one segmentation, the empty one; texts with fewer than n segmentations have
    fewer rows; equal scores keep a fixed order.  A null key stays null; repeated rows are documents of
    their own; an empty table gives no rows.
    """
    names = ["doc_id", "rank", "score", "n_pieces", "ids"]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary()]
    schema = "doc_id long, rank int, score double, n_pieces long, ids binary"
    if decode:
        names, types, schema = [*names, "text"], [*types, pa.string()], f"{schema}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel.of(model)
        gc.disable()  # no reference cycles arise here, and tracing the memo again and again takes a third of the time
        try:
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for part in text_groups(texts, 1 << 20):
                    yield segmented(own, keys[part], texts[part])
        finally:
            gc.enable()

    def segmented(own: PieceModel, keys: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        rows = [(key, rank, score, len(ids) // 4, ids) for key, found in zip(keys, own.encode(texts, n), strict=True) for rank, (score, ids) in enumerate(found, 1)]
        if decode:
            rows = [(*r, t) for r, t in zip(rows, own.decode([r[4] for r in rows]), strict=True)]
        columns = [pa.array(c, pa.binary() if n == "text" else t) for c, n, t in zip(zip(*rows, strict=True), names, types, strict=True)]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run, "pieces"), schema)


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` of nbest_segmentations with a column ``text`` of the decoded ids (null ids: null).

    Null keys and repeated rows stay; an empty table gives no rows.
    """
    names = ["doc_id", "rank", "score", "n_pieces", "ids", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel.of(model)
        for b in batches:
            ids = b.column(4).to_pylist()
            texts = [t.decode("utf-8", "replace") if x is not None else None for x, t in zip(ids, own.decode([x or b"" for x in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return rows.select(*names[:5]).mapInArrow(lean(run, "pieces"), "doc_id long, rank int, score double, n_pieces long, ids binary, text string")
