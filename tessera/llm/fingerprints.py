"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps modular prefix sums of a text's code points (two primes just below 2**31, so
all arithmetic is exact in 64 bits).  Any span's hash follows from two entries, equal spans of any
two texts have equal hashes, and the longest common extension at two places is found by binary
search.

A fingerprint is ``length:hash:prefixes:suffixes:blocks``: the hash of the whole text (62 bits) and
16-bit hashes of its prefixes and suffixes at lengths 1, 2, 3, 4, 5, 6, 8, ... that grow by 2**(1/4).
Two fingerprints alone give lower bounds of the longest common prefix and suffix, again by binary
search, because prefixes that agree agree at every shorter length: a length counts if its hash and
the one below agree, 32 bits together.

The blocks cut the whole text where the hash of the next ``WINDOW`` code points is least among
``REACH`` windows to either side (33 code points a block on average), so an edit moves only the cuts
around it.  Each has a 40-bit span hash, its length and, for a run of equal blocks, how many they are.

Likeness is the length of disjoint spans that both texts have, as a share of the longer text: common
prefix, common suffix and the blocks between that both have, or all blocks that both have if these
are more.  It is a lower bound but for equal hashes of unequal spans (one in 2**32 lengths asked and in 2**40
pairs of blocks); 1 stands for equal texts only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranges import borders
from tessera.llm.workspace import shuffle_width
from tessera.workers import lean

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_013)
WINDOW, REACH = 8, 16
#: Rows whose fingerprints a worker holds at once, and bytes of text of a range of keys.
ROWS, RANGE_BYTES = 256, 12 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of a base and of its inverse modulo a prime; long tables are not kept."""

    KEPT = 1 << 18

    def __init__(self, base: int, prime: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """The prime and at least ``n`` entries of both."""
        p, up, down = np.uint64(self.prime), self.up, self.down
        while len(up) < n:
            k = len(up)
            up = np.concatenate([up, up * np.uint64(pow(self.base, k, self.prime)) % p])
            down = np.concatenate([down, down * np.uint64(pow(self.inverse, k, self.prime)) % p])
        if len(up) <= self.KEPT:
            self.up, self.down = up, down
        return p, up, down


_powers = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
_ladder = np.unique(np.floor(2.0 ** (np.arange(200) / 4)).astype(np.int64))


class PrefixHash:
    """Modular prefix arrays of a text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.prefix = []  # of each prime: itself, prefix sums, inverse powers
        for w in _powers:
            p, up, down = w.of(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * up[: self.n] % p, out=sums[1:])
            self.prefix.append((p, sums % p, down))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        out = np.zeros(len(starts), np.uint64)
        for p, sums, down in self.prefix:
            out = (out << np.uint64(31)) | (sums[ends] + p - sums[starts]) % p * down[starts] % p
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common span from ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def cuts(self) -> np.ndarray:
        """Borders of the content-defined blocks, with 0 and the length."""
        n = self.n - WINDOW + 1
        inner = np.zeros(0, np.int64)
        if n > 1:
            p, sums, down = self.prefix[0]
            h = (((sums[WINDOW:] + p - sums[:-WINDOW]) % p * down[:n] % p + np.uint64(1)) * _GOLDEN >> np.uint64(32)).astype(np.uint32)
            least = np.full(n + 2 * REACH, np.iinfo(np.uint32).max, np.uint32)
            least[REACH : REACH + n] = h
            width = 1
            while width < 2 * REACH + 1:
                step = min(width, 2 * REACH + 1 - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            inner = np.flatnonzero(h == least)
            inner = inner[inner > 0]
        return np.concatenate([[0], inner, [self.n]])

    def blocks(self) -> str:
        """``hash`` (10 hex digits) and length (hex) of each block, ``*`` and the number for a run of equal ones."""
        if not self.n:
            return ""
        cuts = self.cuts()
        hashes = (self.spans(cuts[:-1], cuts[1:]) * _GOLDEN >> np.uint64(24)).astype(np.int64)
        sizes = np.diff(cuts)
        first = np.concatenate([[0], np.flatnonzero((np.diff(hashes) != 0) | (np.diff(sizes) != 0)) + 1])
        runs = np.diff(np.append(first, len(sizes)))
        return ",".join([f"{h:010x}{m:x}" if k == 1 else f"{h:010x}{m:x}*{k}" for h, m, k in zip(hashes[first].tolist(), sizes[first].tolist(), runs.tolist(), strict=True)])

    def fingerprint(self) -> str:
        lengths = _ladder[: np.searchsorted(_ladder, self.n, "right")]
        zero = np.zeros(len(lengths), np.int64)
        short = lambda h: "".join(f"{x:04x}" for x in (h * _GOLDEN >> np.uint64(48)).tolist())
        return f"{self.n}:{self.span(0, self.n):016x}:{short(self.spans(zero, lengths))}:{short(self.spans(self.n - lengths, zero + self.n))}:{self.blocks()}"


def fingerprint(text: str | None) -> str:
    """A null text counts as empty."""
    return PrefixHash(text or "").fingerprint()


def _agreeing(a: str, b: str) -> int:
    """Length up to which two ladders agree; a rung counts only together with the one below it."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if a[max(0, 4 * mid - 8) : 4 * mid] == b[max(0, 4 * mid - 8) : 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return int(_ladder[low - 1]) if low else 0


def _within(blocks: list[str], common: set[str], low: int, high: int) -> Counter[str]:
    """How often each of the ``common`` blocks lies whole in [low, high)."""
    found: Counter[str] = Counter()
    at = 0
    for b in blocks:
        one, _, run = b.partition("*")
        size, n = int(one[10:], 16), int(run or 1)
        if one in common:
            inside = min(n, (high - at) // size) - max(0, -((at - low) // size))
            if inside > 0:
                found[one] += inside
        at += size * n
    return found


def _shared(x: list[str], y: list[str], common: set[str], prefix: int, suffix: int, sizes: tuple[int, int]) -> int:
    """Length of the blocks that both texts have between a prefix and a suffix."""
    both = _within(x, common, prefix, sizes[0] - suffix) & _within(y, common, prefix, sizes[1] - suffix)
    return sum(int(one[10:], 16) * n for one, n in both.items())


def likeness(a: str, b: str) -> float:
    """Likeness of two texts by their fingerprints: 1 if equal, 0 without a common end or block."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    sizes = int(x[0]), int(y[0])
    most, least = max(sizes), min(sizes)
    prefix, suffix = _agreeing(x[2], y[2]), _agreeing(x[3], y[3])
    shared = min(least, prefix + suffix)
    own, other = x[4].split(",") if x[4] else [], y[4].split(",") if y[4] else []
    common = {one.partition("*")[0] for one in own} & {one.partition("*")[0] for one in other}
    if common:
        inner = _shared(own, other, common, prefix, suffix, sizes) if prefix + suffix < least else 0
        shared = max(shared + inner, _shared(own, other, common, 0, 0, sizes))
    return min(shared / most, 1 - 1 / (most + 1))


def _shard(cuts: list[int]) -> F.Column:
    """How many of the descending ``cuts`` lie above the id: binary search in an array literal."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts]) if len(cuts) <= 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    above = lambda at: F.coalesce(F.try_element_at(array, at) > F.col("doc_id"), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & above(at + step), at + step).otherwise(at))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, ahead, doc_id, text) laid out so that each row's successor in descending key order follows it.

    Keys are cut into shards of about equal numbers of rows, one a task; the first document of a shard
    is also sent behind the last one of the shard before (and the very first behind the very last).
    One shuffle.  Null keys come last; equal keys are ordered by text.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_rows, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found = borders(rows, "doc_id", max(shuffle_width(docs.sparkSession), -(-size // RANGE_BYTES)), n_rows)
    cuts = sorted(found.tolist(), reverse=True)
    placed = rows.withColumn("shard", _shard(cuts))
    firsts = {r.shard: r.top for r in placed.groupBy("shard").agg(F.max("doc_id").alias("top")).collect()}  # one row a shard
    used = sorted(firsts)
    n = len(cuts) + 1
    top = [firsts.get(s) for s in range(n)]
    before = {s: used[i - 1] for i, s in enumerate(used)}
    literal = lambda values: F.from_json(F.lit(str([-1 if v is None else v for v in values])), "array<bigint>")
    tops, befores = literal(top), literal([before.get(s) for s in range(n)])
    own = F.struct(F.col("shard").cast("long").alias("s"), F.lit(False).alias("ahead"))
    early = F.struct(F.element_at(befores, F.col("shard") + 1).alias("s"), F.lit(True).alias("ahead"))
    twice = placed.withColumn("to", F.explode(F.when(F.col("doc_id") == F.element_at(tops, F.col("shard") + 1), F.array(own, early)).otherwise(F.array(own))))
    dealt = twice.select(F.col("to.s").cast("int").alias("shard"), F.col("to.ahead").alias("ahead"), "doc_id", "text")
    return dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "ahead", F.desc("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many code points from the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A null text counts as empty (likeness 1 to another empty one).  A sole document is its own
    successor.  Null keys come last and stay null; repeated rows are documents of their own.  An
    empty table stays empty.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document whose successor has not come yet
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows = []
            for shard, ahead, doc, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None and ahead:
                    continue
                mark = fingerprint(own)
                if held is not None and held[0] == shard:
                    _, before, old, old_mark = held
                    change = edited(old, own)
                    new_mark = fingerprint(change)
                    rows.append((None if before == -(2**63) else before, len(old), sha256(change.encode()).hexdigest(), old_mark, new_mark, likeness(old_mark, new_mark), likeness(old_mark, mark)))
                held = None if ahead else (shard, doc, own, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return with_next(docs, key, text).mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
