"""Byte-level BPE ids through the ``tokenizers`` library, memoised by word.

Byte-level pre-tokenization never joins characters across a single blank or line feed that has
a non-space character on both sides, so a text falls into chunks there: a word with the blank or
line feed before it.  Words are found and hashed by array operations, each distinct chunk of a slice
is looked up once in a memo of bounded size, and only unknown ones go through the library (a final
comma or full stop after a letter is a token of its own and is taken off first).  Texts with any
other white space go through the library whole.

The string of an added token (``<|endoftext|>``) in a text is ordinary text, or with ``literal`` false
that token, as the library has it when the file is loaded; texts with one then go through it whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.workers import kept, lean

MEMO_SLOTS_LOG2 = 22
MEMO_IDS = 12_000_000
_letters = "A-Za-zÀ-ÖØ-öø-ɏ"
_simple = re.compile(rf"[ !-&(-~{_letters}]+")
_parts = re.compile(rf" ?[{_letters}]+| ?[0-9]+| ?[^ 0-9{_letters}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo:
    """Ids of words by 64-bit key: a direct-mapped table, where a newer word takes an older one's slot.

    Emptied when the ids it points into reach ``MEMO_IDS``, so its size is bounded.
    """

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.uint32)
        self.clear()

    def clear(self) -> None:
        n = 1 << MEMO_SLOTS_LOG2
        self.keys, self.first, self.sizes, self.end = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.uint16), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first, size): where in ``flat`` each key's ids are."""
        slot = (keys >> np.uint64(64 - MEMO_SLOTS_LOG2)).astype(np.int32)
        return self.keys[slot] == keys, self.first[slot].astype(np.int64), self.sizes[slot].astype(np.int64)

    def add(self, keys: np.ndarray, new: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep ids (one key's after the other's); returns where in ``flat`` they are now, even if another key takes the slot."""
        if self.end + len(new) > len(self.flat):
            grown = np.zeros(self.end * 3 // 2 + len(new), np.uint32)
            grown[: self.end] = self.flat[: self.end]
            self.flat = grown
        self.flat[self.end : self.end + len(new)] = new
        first = self.end + np.cumsum(sizes) - sizes
        self.end += len(new)
        fit = sizes < 1 << 16  # a word with more ids is not remembered
        slot = (keys[fit] >> np.uint64(64 - MEMO_SLOTS_LOG2)).astype(np.int32)
        self.keys[slot], self.first[slot], self.sizes[slot] = keys[fit], first[fit], sizes[fit]
        return first


def _unusual(data: np.ndarray) -> np.ndarray:
    """Positions of control separators and of the UTF-8 forms of white space beyond ASCII."""
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    third = np.zeros(len(data), np.uint8)
    third[:-2] = data[2:]
    control = (data >= 0x1C) & (data <= 0x1F)
    two = (data == 0xC2) & ((after == 0x85) | (after == 0xA0))
    general = (data == 0xE2) & (after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    rest = ((data == 0xE1) & (after == 0x9A)) | ((data == 0xE2) & (after == 0x81)) | ((data == 0xE3) & (after == 0x80))
    return np.flatnonzero(control | two | general | rest)


def _byte_marks() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    marks = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in marks:
            marks[b] = chr(256 + len(marks) - len(plain))
    return marks


def _chunk_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of words together with the blank or line feed before them (0: none)."""
    return arrays.mix(arrays.word_hashes(data, starts, ends) + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Encoder:
    """Text to ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = None if literal else self._added()
        self.memo = Memo()
        self.stop = {c: int(np.frombuffer(self.library([c])[0], np.uint32)[0]) for c in (",", ".")}
        self.byte_marks = _byte_marks()
        self.signs: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str, literal: bool = True) -> Encoder:
        own = kept("tokens")
        if (path, literal) not in own:
            own[path, literal] = cls(path, literal)
        return own[path, literal]

    def _added(self) -> re.Pattern[bytes] | None:
        """What may become an added token in a text's bytes; any non-empty text if that cannot be told from its content."""
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in tokens) and self.tokenizer.normalizer is not None:
            return re.compile(rb"(?s).")
        return re.compile(b"|".join(re.escape(t.content.encode()) for t in tokens)) if tokens else None

    def library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2048):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)]
        return out

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has.

        A chunk of Latin letters, digits and ASCII signs without an apostrophe falls into pre-tokens by
        a simple pattern, and the library's model takes these directly; others take the whole library.
        """
        flat: list[int] = []
        sizes = np.zeros(len(chunks), np.int64)
        other, model, marks, signs = [], self.tokenizer.model.tokenize, self.byte_marks, self.signs
        for i, c in enumerate(chunks):
            plain = c[1:] if c[0] == " " else c
            if plain.isalpha() and plain.isascii():
                ids = [t.id for t in model("\u0120" + plain if c[0] == " " else c)]
            elif _simple.fullmatch(c):
                ids = []
                for part in _parts.findall(c):
                    own = signs.get(part)
                    if own is None:
                        own = [t.id for t in model(part.encode().decode("latin-1").translate(marks))]
                        if len(part) < 4 and len(signs) < 100_000:
                            signs[part] = own
                    ids += own
            else:
                other.append(i)
                continue
            flat += ids
            sizes[i] = len(ids)
        new = np.array(flat, np.uint32)
        if other:
            found = [np.frombuffer(x, np.uint32) for x in self.library([chunks[i] for i in other])]
            at = np.cumsum(sizes)[other]
            sizes[other] = [len(f) for f in found]
            new = np.insert(new, np.repeat(at, sizes[other]), np.concatenate(found))
        return new, sizes

    def _learn(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memoise chunks that the memo does not have; returns where their ids are, and how many."""
        final = data[ends - 1]
        letter = data[np.maximum(ends - 2, 0)] | 0x20
        trim = ((final == 0x2C) | (final == 0x2E)) & (ends - starts > 1) & (letter >= 0x61) & (letter <= 0x7A)
        stems = _chunk_keys(data, starts, ends - trim, before)
        known, first, size = self.memo.find(stems)
        begin, stop = starts - (before > 0), ends - trim
        new = np.flatnonzero(~known)
        unique, where, inverse = np.unique(stems[new], return_index=True, return_inverse=True)
        where = new[where]
        fresh, sizes = self._words([raw[a:b].decode() for a, b in zip(begin[where].tolist(), stop[where].tolist(), strict=True)])
        first[new], size[new] = self.memo.add(unique, fresh, sizes)[inverse], sizes[inverse]
        cut = np.flatnonzero(trim)
        longer = size[cut] + 1
        upto = np.cumsum(longer)
        place = np.repeat(first[cut] - (upto - longer), longer) + np.arange(int(longer.sum()))
        whole = self.memo.flat[np.minimum(place, len(self.memo.flat) - 1)]
        whole[upto - 1] = np.where(final[cut] == 0x2C, self.stop[","], self.stop["."])
        first[cut] = self.memo.add(keys[cut], whole, longer)
        size[cut] = longer
        return first, size

    def column(self, texts: pa.Array, tail: bytes = b"") -> Iterator[tuple[int, int, list[bytes]]]:
        """(first text, end, ids of each text with ``tail`` behind), slice by slice."""
        data, offsets = arrays.text_buffers(texts)
        for a, b in arrays.slices(offsets):
            yield a, b, self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tail)

    def _slice(self, data: np.ndarray, offsets: np.ndarray, tail: bytes) -> list[bytes]:
        starts, ends, by_text = arrays.word_spans(data, offsets)
        n = len(offsets) - 1
        counts = np.diff(by_text)
        owner = np.repeat(np.arange(n), counts)
        odd = (counts == 0) & (np.diff(offsets) > 0)
        odd[np.searchsorted(offsets, _unusual(data), "right") - 1] = True
        leads = np.ones(len(starts), bool)
        leads[1:] = owner[1:] != owner[:-1]
        gap = np.where(leads, starts - offsets[owner], 0)
        gap[1:] = np.where(leads[1:], gap[1:], starts[1:] - ends[:-1])
        before = np.where(leads, 0, data[starts - 1] if len(starts) else 0)
        wrong = np.where(leads, gap != 0, (gap != 1) | ((before != 0x20) & (before != 0x0A)))
        odd[owner[wrong]] = True
        last = by_text[1:][counts > 0] - 1
        odd[owner[last][ends[last] != offsets[owner[last] + 1]]] = True
        keys = _chunk_keys(data, starts, ends, before)
        raw = data.tobytes()
        if self.added is not None:
            found = [m.start() for m in self.added.finditer(raw)]
            odd[np.searchsorted(offsets, np.array(found, np.int64), "right") - 1] = True
        if self.memo.end > MEMO_IDS:
            self.memo.clear()
        known, first, per = self.memo.find(keys)
        per[~known] = 0
        new = np.flatnonzero(~known & ~odd[owner])
        if len(new):
            unique, where, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            w = new[where]
            place, size = self._learn(raw, data, starts[w], ends[w], before[w], unique)
            first[new], per[new] = place[inverse], size[inverse]
        upto = np.concatenate([[0], np.cumsum(per)])
        ids = self.memo.flat[np.repeat(first - upto[:-1], per) + np.arange(int(upto[-1]))].tobytes()
        cut = (upto[by_text] * 4).tolist()
        out = [ids[x:y] + tail for x, y in zip(cut[:-1], cut[1:], strict=True)]
        whole = np.flatnonzero(odd).tolist()
        if whole:
            texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in whole]
            for i, found_ids in zip(whole, self.library(texts), strict=True):
                out[i] = found_ids + tail
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out: list[bytes] = []
        for _, _, part in self.column(pa.array(texts, pa.string())):
            out += part
        return out


def text_groups(texts: list[str | None], limit: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters, so that one step's memory is bounded."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def tokenize(docs: DataFrame, path: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", literal: bool = True) -> DataFrame:
    """(key, n_tokens, ids) of every whole text, in the input's partitions, without a shuffle.

    A null or empty text has no ids but ``end_id``; a null key stays null; repeated rows stay.
    """
    tail = b"" if end_id is None else array("I", [end_id]).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, literal)
        for batch in batches:
            for a, b, ids in encoder.column(batch.column(1), tail):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    picked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(lean(run, "tokens"), "doc_id long, n_tokens long, ids binary")
