"""Language identification by a linear-chain conditional random field over words.

A word (a run of letters) gets scores for each language from hashed character bigrams and trigrams
with word borders, prefixes and suffixes of three letters, and a lexicon of frequent words; learned
transitions tie neighbouring words, so that code-switched texts get runs of labels.  Marginals come
from forward-backward; a document's language is the one with the largest mean marginal.

Forward-backward is exact and runs over all texts of a slice at once: sequences are cut into blocks
of 64 words, block transfer matrices carry the messages from block to block (a step for each block of the
slice's longest text), and then all blocks advance together.  A text longer than a slice is read in slices that
cut no word, forward first, for the messages into each, then backward for the marginals; the result is
that of one pass.  Arrays are those of one slice, about 90 bytes a character; only a single run of letters that is
longer than a slice makes them larger.

The model is fitted on the driver on a bounded sample of labelled rows: of each language the documents
with the smallest key hashes, at most ``SAMPLE_PER_LANGUAGE`` of them and none after the one that
reaches ``SAMPLE_CHARS`` characters, each with its whole text.  Training is stochastic: ``ROUNDS``
rounds of ``ROUND_SPANS`` spans of 4 to 21 words, drawn anew.  The model's size is fixed by
``BUCKETS`` and ``LEXICON``.  Texts to label are read whole, where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import nullable
from tessera.llm.tokens import text_groups
from tessera.workers import lean

SAMPLE_PER_LANGUAGE = 160
SAMPLE_CHARS = 1_000_000
#: More labels than this are no languages but an error of the caller's.
MOST_LANGUAGES = 500
ROUNDS, ROUND_SPANS = 6, 4000
BUCKETS = 1 << 16
LEXICON = 4000
UNDETERMINED = "und"
#: Characters of a slice times the number of languages (at least 8).
SLICE_CHARS = 8 << 20
_BLOCK = 64
_tables: list[np.ndarray] = []


def _letters() -> list[np.ndarray]:
    """By code point: is it a letter, and its lower case."""
    if not _tables:
        letter, low = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                lower = c.lower()
                if len(lower) == 1:
                    low[i] = ord(lower)
        _tables.extend((letter, low))
    return _tables


@dataclass
class Words:
    """Words of a run of texts: framed letters (1 before and 2 after each word), places, owners."""

    framed: np.ndarray
    first: np.ndarray  # n + 1 offsets into framed
    start: np.ndarray  # in code points over all texts
    end: np.ndarray
    offsets: np.ndarray  # word offsets by text


def split(texts: list[str | None]) -> Words:
    letter, low = _letters()
    sizes = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    on = np.zeros(len(points) + 2, bool)
    on[1:-1] = letter[np.minimum(points, 0x10FFFF)]
    begin, stop = on[1:] & ~on[:-1], on[:-1] & ~on[1:]
    inner = bounds[1:-1]
    joined = inner[on[inner] & on[inner + 1]]  # a word may not cross into the next text
    begin[joined] = stop[joined] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length + 2)])
    framed = np.full(int(first[-1]), 2, np.uint32)
    framed[first[:-1]] = 1
    within = np.arange(int(length.sum())) - np.repeat(np.concatenate([[0], np.cumsum(length)])[:-1], length)
    framed[np.repeat(first[:-1] + 1, length) + within] = low[points[np.repeat(start, length) + within]]
    return Words(framed, first, start, end, np.searchsorted(start, bounds))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(40)


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bucket of each feature, offsets of its words): n-grams with borders, then affixes."""
    c = w.framed.astype(np.uint64)
    two = np.zeros(len(c), np.uint64)
    three = np.zeros(len(c), np.uint64)
    if len(c):
        two[:-1] = c[:-1] << np.uint64(21) | c[1:]
        three[:-2] = two[:-2] << np.uint64(21) | c[2:]
    first, last = w.first[:-1], w.first[1:]
    mask = np.uint64(BUCKETS - 1)
    b2 = (_scramble(two + np.uint64(1 << 63)) & mask).astype(np.int32)
    b3 = (_scramble(three) & mask).astype(np.int32)
    # the last place of a word starts no bigram, the last two no trigram: they go to bucket 0 of an unused row
    b2[last - 1] = BUCKETS
    b3[last - 1] = BUCKETS
    b3[last - 2] = BUCKETS
    size = last - first
    take = np.minimum(size - 1, 3)
    prefix = _scramble(three[first] * np.uint64(31) + c[first + take]) & mask
    suffix = _scramble(three[last - np.minimum(size, 4)] * np.uint64(37) + c[last - 1] + np.uint64(1 << 62)) & mask
    affixes = np.stack([prefix, suffix], axis=1).astype(np.int32)
    return [(b2, first), (b3, first), (affixes, first)]


def word_keys(w: Words) -> np.ndarray:
    """A 64-bit key of each word for the lexicon."""
    if len(w.first) == 1:
        return np.zeros(0, np.uint64)
    place = np.arange(len(w.framed)) - np.repeat(w.first[:-1], np.diff(w.first))
    x = (w.framed.astype(np.uint64) + np.uint64(977)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9))
    x ^= x >> np.uint64(32)
    return np.add.reduceat(x * np.uint64(0x94D049BB133111EB), w.first[:-1])


class Model:
    """Weights of a fitted field."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        k = len(languages)
        self.languages, self.lexicon = languages, np.sort(lexicon)
        self.weights = np.zeros((BUCKETS + 1, k), np.float32)
        self.entries = np.zeros((len(lexicon) + 1, k), np.float32)
        self.transitions = np.zeros((k, k))
        self.initial = np.zeros(k)

    def lexicon_rows(self, w: Words) -> np.ndarray:
        """Row of each word in ``entries``; the last row is for words that are not in the lexicon."""
        keys = word_keys(w)
        at = np.minimum(np.searchsorted(self.lexicon, keys), max(0, len(self.lexicon) - 1))
        return np.where(self.lexicon[at] == keys, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(keys), np.int64)

    def emissions(self, w: Words) -> np.ndarray:
        if len(w.first) == 1:
            return np.zeros((0, len(self.languages)))
        (b2, first), (b3, _), (affixes, _) = features(w)
        grams = self.weights[b2]
        grams += self.weights[b3]
        out = np.add.reduceat(grams, first, axis=0)
        out += self.weights[affixes[:, 0]] + self.weights[affixes[:, 1]] + self.entries[self.lexicon_rows(w)]
        return out.astype(np.float64)

    def marginals(self, emissions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return forward_backward(emissions, offsets, self.transitions, self.initial)

    def slice_marginals(self, text: str, size: int) -> Iterator[tuple[int, Words, np.ndarray]]:
        """(start, words, marginals) of the slices of one text, the last slice first."""
        spans = cuts(text, size)
        words = lambda a, b: split([text[a:b]])
        enter: list[np.ndarray | None] = [None]
        for a, b in spans[:-1]:
            enter.append(self._pass(words(a, b), enter[-1], None)[1])
        leave = None
        for (a, b), before in zip(reversed(spans), reversed(enter), strict=True):
            w = words(a, b)
            marginal, _, leave = self._pass(w, before, leave)
            yield a, w, marginal

    def _pass(self, w: Words, enter: np.ndarray | None, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        if len(w.start) == 0:
            return np.zeros((0, len(self.languages))), enter, leave
        return _messages(self.emissions(w), w.offsets, self.transitions, self.initial, None, enter, leave)


def cuts(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of at least ``size`` characters (the last one of what is left) that no word crosses."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and text[to - 1].isalpha() and text[to].isalpha():
            to += 1
        out.append((at, to))
        at = to
    return out


def forward_backward(emissions: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, initial: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of each word of the sequences between ``offsets``; adds pair marginals to ``pairs``."""
    if len(emissions) == 0:
        return np.zeros((0, emissions.shape[1]))
    return _messages(emissions, offsets, transitions, initial, pairs, None, None)[0]


def _messages(emissions: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, initial: np.ndarray, pairs: np.ndarray | None, before: np.ndarray | None, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, and the messages behind the last word and to before the first one.

    With one sequence ``before`` and ``after`` are such messages of what precedes and follows it.
    """
    n, k = emissions.shape
    sizes = np.diff(offsets)
    per = -(-sizes // _BLOCK)
    nb = int(per.sum())
    block0 = np.concatenate([[0], np.cumsum(per)])
    sequence = np.repeat(np.arange(len(sizes)), per)
    index = np.arange(nb) - block0[sequence]
    start = offsets[sequence] + index * _BLOCK
    width = np.minimum(_BLOCK, offsets[sequence + 1] - start)
    place = start[:, None] + np.arange(_BLOCK)[None, :]
    inside = np.arange(_BLOCK)[None, :] < width[:, None]
    p = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    p = p[np.where(inside, place, 0)]  # nb x block x k
    a = np.exp(transitions - transitions.max())
    opening = np.exp(initial - initial.max())
    first_block = (index == 0) & (before is None)
    # transfer matrix of each block; a sequence's first word is entered by ``opening`` and not by ``a``
    if nb > len(sizes[sizes > 0]):
        m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
        for s in range(_BLOCK):
            step = (m.reshape(-1, k) @ a).reshape(nb, k, k)
            if s == 0:
                step[first_block] = m[first_block]
            step *= p[:, s][:, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            m = np.where(inside[:, s][:, None, None], step, m)
    enter, leave = np.zeros((nb, k)), np.ones((nb, k))
    enter[first_block] = opening
    if before is not None:
        enter[0] = before
    if after is not None:
        leave[-1] = after
    depth = int(per.max())
    for j in range(1, depth):
        on = block0[:-1][per > j] + j
        v = np.einsum("ij,ijk->ik", enter[on - 1], m[on - 1])
        enter[on] = v / v.sum(axis=1, keepdims=True)
    for j in range(depth - 1, 0, -1):
        on = block0[:-1][per > j] + j
        v = np.einsum("ijk,ik->ij", m[on], leave[on])
        leave[on - 1] = v / v.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((nb, _BLOCK, k)), np.empty((nb, _BLOCK, k))
    now = enter
    for s in range(_BLOCK):
        step = now @ a
        if s == 0:
            step[first_block] = now[first_block]
        step = step * p[:, s]
        step /= step.sum(axis=1, keepdims=True)
        alpha[:, s] = step
        now = step
    now = leave
    for s in range(_BLOCK - 1, -1, -1):
        on = inside[:, s][:, None]
        beta[:, s] = now
        step = (p[:, s] * now) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(on, step, now)
    joint = alpha * beta
    joint /= joint.sum(axis=2, keepdims=True)
    out = np.empty((n, k))
    out[place[inside]] = joint[inside]
    if pairs is not None:  # training: sequences of at most one block
        flow = alpha[:, :-1, :, None] * a[None, None] * (p[:, 1:] * beta[:, 1:])[:, :, None, :]
        flow /= flow.sum(axis=(2, 3), keepdims=True)
        pairs += flow[inside[:, 1:]].sum(axis=0)
    return out, alpha[-1, width[-1] - 1], now[0] / now[0].sum()


def fit(samples: list[tuple[str, str]], seed: int = 7, rounds: int = ROUNDS, batch: int = 96) -> Model:
    """Fit on (language, text) pairs: spans of a text, a third of them spliced from two or three languages.

    Three spans have at most 63 words, which a block of the forward-backward pass holds.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({label for label, _ in samples})
    code = {label: i for i, label in enumerate(languages)}
    counts: dict[int, np.ndarray] = {}
    spans: list[list[str]] = [[] for _ in languages]
    for label, text in samples:
        w = split([text])
        for key, n in zip(*np.unique(word_keys(w), return_counts=True), strict=True):
            counts.setdefault(int(key), np.zeros(len(languages)))[code[label]] += n
        n_words, at = len(w.start), 0
        while at < n_words:
            to = min(n_words, at + int(rng.integers(4, 22)))
            spans[code[label]].append(text[w.start[at] : w.end[to - 1]])
            at = to
    top = sorted(counts, key=lambda key: (-counts[key].sum(), key))[:LEXICON]
    model = Model(languages, np.array(top, np.uint64))
    k = len(languages)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.entries, model.transitions, model.initial)]
    total = sum(map(len, spans))
    present = [i for i in range(k) if spans[i]]
    for _ in range(rounds if present else 0):
        for _ in range(max(1, min(ROUND_SPANS, total) // batch)):
            texts, labels, owner = [], [], []
            for s in range(batch):
                parts = rng.choice(present, size=int(rng.integers(2, 4)) if rng.random() < 1 / 3 else 1)
                for i in parts:
                    texts.append(spans[i][int(rng.integers(len(spans[i])))])
                    labels.append(i)
                    owner.append(s)
            w = split(texts)
            per_text = np.diff(w.offsets)
            gold = np.repeat(labels, per_text)
            sizes = np.bincount(owner, weights=per_text, minlength=batch).astype(np.int64)
            emissions = model.emissions(w)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            pairs = np.zeros((k, k))
            error = np.eye(k)[gold] - forward_backward(emissions, offsets, model.transitions, model.initial, pairs)
            (b2, first), (b3, _), (affixes, _) = features(w)
            spread = np.repeat(error, np.diff(w.first), axis=0)
            gradient = np.zeros(model.weights.shape)
            for buckets, values in ((b2, spread), (b3, spread), (affixes[:, 0], error), (affixes[:, 1], error)):
                np.add.at(gradient, buckets, values)
            gradient[BUCKETS] = 0
            lexical = np.zeros(model.entries.shape)
            np.add.at(lexical, model.lexicon_rows(w), error)
            lexical[-1] = 0
            seen = np.zeros((k, k))
            heads = offsets[:-1][sizes > 0]
            follow = np.ones(len(gold), bool)
            follow[heads] = False
            at = np.flatnonzero(follow)
            np.add.at(seen, (gold[at - 1], gold[at]), 1)
            opening = error[heads].sum(axis=0)
            for x, grad, sq in zip((model.weights, model.entries, model.transitions, model.initial), (gradient, lexical, seen - pairs, opening), squares, strict=True):
                grad = grad / batch
                sq += grad * grad
                x += (0.3 * grad / np.sqrt(sq)).astype(x.dtype) * (grad != 0)
    return model


def labelled_sample(rows: DataFrame, label: str, text: str, key: str) -> list[tuple[str, str]]:
    """(label, whole text): of each label the rows with the smallest key hashes, at most
    ``SAMPLE_PER_LANGUAGE`` and none after the one that reaches ``SAMPLE_CHARS`` characters.

    Rows with a null label, text or key are not taken; of rows with one label and key one is; an empty
    table gives an empty sample; more than ``MOST_LANGUAGES`` labels are an error.  A share of each label's
    hash range that holds about three times as many rows is looked at first, lengths before texts, so
    neither a frequent label nor long texts meet in one task.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {label!r}")
    if not counts:
        return []
    top = (1 << 53) - 1
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r.label, int(top * min(1.0, 3 * SAMPLE_PER_LANGUAGE / r.n)))])
    picked = known.select(F.col(label).alias("label"), F.xxhash64(F.col(key)).bitwiseAND(top).alias("h"), F.col(text).alias("text"))
    lengths = picked.where(F.col("h") <= limits[F.col("label")]).groupBy("label", "h").agg(F.max(F.char_length("text")).alias("chars"))
    wanted, at = [], {}
    for r in sorted(lengths.collect()):
        n, chars = at.get(r.label, (0, 0))
        if n < SAMPLE_PER_LANGUAGE and chars < SAMPLE_CHARS:
            wanted.append((r.label, r.h))
            at[r.label] = n + 1, chars + r.chars
    few = spark.createDataFrame(wanted, "label string, h long")  # at most SAMPLE_PER_LANGUAGE * MOST_LANGUAGES rows
    found = picked.join(F.broadcast(few), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))
    return [(r.label, r.text) for r in sorted(found.collect())]


def learned_rows(docs: DataFrame, key: str = "doc_id") -> tuple[Column, DataFrame]:
    """The held-out condition (a quarter of the ids by CRC-32) and the rows to learn from."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
    return held, docs.where(~held & F.col(key).isNotNull())


def _label(model: Model, texts: list[str | None], size: int, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """By text: words, summed marginals by language, summed largest marginals, labelled runs."""
    k = len(model.languages)
    long = [i for i, t in enumerate(texts) if len(t or "") > size and k]
    short = [None if len(t or "") > size and k else t for t in texts]
    w = split(short)
    n, runs = np.diff(w.offsets), []
    sums, sure = np.zeros((len(n), k)), np.zeros(len(n))
    if k:
        marginal = model.marginals(model.emissions(w), w.offsets)
        total = np.concatenate([np.zeros((1, k)), np.cumsum(marginal, axis=0)])
        largest = np.concatenate([[0.0], np.cumsum(marginal.max(axis=1))])
        sums, sure = total[w.offsets[1:]] - total[w.offsets[:-1]], largest[w.offsets[1:]] - largest[w.offsets[:-1]]
    if spans:
        runs = _runs(w, short, marginal.argmax(axis=1) if k else None, model.languages)
    for i in long:
        turned: list[dict] = []  # last run first
        for start, w, marginal in model.slice_marginals(texts[i], size):
            n[i] += len(marginal)
            sums[i] += marginal.sum(axis=0)
            sure[i] += marginal.max(axis=1).sum()
            found = _runs(w, [None], marginal.argmax(axis=1), model.languages)[0] if spans else []
            for r in reversed(found):
                r = {"lang": r["lang"], "start": r["start"] + start, "end": r["end"] + start}
                if turned and turned[-1]["lang"] == r["lang"]:
                    turned[-1]["start"] = r["start"]
                else:
                    turned.append(r)
        if spans:
            runs[i] = turned[::-1]
    return n, sums, sure, runs


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """The input's columns (or those of ``keep``) in a struct ``row``, then lang_pred, score, n_words and certainty (and spans).

    ``score`` is the mean marginal of the predicted language over the words, ``certainty`` the mean of
    each word's largest marginal: a text in several languages can have a small score and sure labels.
    A null text and one without a letter get ``und`` and 0; where nothing could be learned every text does.
    ``spans`` gives the labelled runs of words as (lang, start, end) in code points.  Every row stays as
    it is, those with null keys and repeated ones too; an empty table stays empty.
    """
    names = ["row", "lang_pred", "score", "n_words", "certainty"] + ["spans"] * spans
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    size = SLICE_CHARS // max(8, len(model.languages))  # a word takes room for each label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = b.column(0).cast(nullable(b.column(0).type))
            for part in text_groups(texts, size):
                own = texts[part]
                n, sums, sure, runs = _label(model, own, size, spans)
                many = np.maximum(n, 1)
                if model.languages:
                    mean = sums / many[:, None]
                    best, known = mean.argmax(axis=1), n > 0
                    score = np.clip(mean[np.arange(len(n)), best], 0.0, 1.0)
                    certainty = np.clip(sure / many, 0.0, 1.0)
                else:
                    best, score, certainty, known = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
                lang = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, known, strict=True)]
                columns = [rows.slice(part.start, len(own)), pa.array(lang), pa.array(np.where(known, score, 0.0)), pa.array(n, pa.int64()), pa.array(np.where(known, certainty, 0.0))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(runs, span_type)] * spans, names=names)

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    picked = docs.select(row.alias("row"), F.col(text).alias("text"))
    schema = f"row {picked.schema['row'].dataType.simpleString()}, lang_pred string, score double, n_words long, certainty double" + ", spans array<struct<lang:string,start:long,end:long>>" * spans
    return picked.mapInArrow(lean(run, "language"), schema)


def _runs(w: Words, texts: list[str | None], labels: np.ndarray | None, languages: list[str]) -> list[list[dict]]:
    out, at = [], 0
    for i, t in enumerate(texts):
        a, b = int(w.offsets[i]), int(w.offsets[i + 1])
        rows: list[dict] = []
        if labels is not None and b > a:
            turn = np.flatnonzero(np.diff(labels[a:b])) + 1
            for x, y in zip(np.concatenate([[0], turn]), np.concatenate([turn, [b - a]]), strict=True):
                rows.append({"lang": languages[labels[a + x]], "start": int(w.start[a + x] - at), "end": int(w.end[a + y - 1] - at)})
        out.append(rows)
        at += len(t or "")
    return out
