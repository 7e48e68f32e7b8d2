"""Keyed time state that leaves by itself: the rules of ``state`` with event-time timers.

Each key has a value of its own and one timer.  The timer stands at the moment from which the value can no
longer change a decision; once the watermark has passed it the value is cleared.  A row at or after that
moment is decided as if the key were new, so results are those of a state kept for ever, and the state
holds only keys that were busy within ``late`` and the rule's own span.  Rows older than the watermark are
dropped by Spark as late.  Runs that end (``availableNow``) and runs that go on both clear state.

Rows of a key in a micro-batch are taken in the order of (t, ord).  They are held as 16 (with a cooldown 24) bytes
each and decided by jumps from one accepted row to the next, so a hot key costs arrays and not frames.  A
null key is a key; rows with a null ``t`` cannot be placed in time and are left out.

Start such a query within ``keyed_state(spark)``, which selects the RocksDB state store that Spark asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.config import Config

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROWS_OUT = 100_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store for queries that start inside; what the session had is set again at the end."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _first(t: np.ndarray, since: float, fits, low: int) -> int:
    """The first place from ``low`` whose time ``fits``; ``since`` is about where that begins."""
    i = max(low, int(np.searchsorted(t, since)))
    while i > low and fits(t[i - 1]):
        i -= 1
    while i < len(t) and not fits(t[i]):
        i += 1
    return i


class Due:
    """Accepted if never before, or ``ttl`` after the last accepted row."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def decide(self, kept: list[float], t: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, list[float]]:
        ok, at = np.zeros(len(t), bool), 0
        while True:
            if kept:
                last = kept[0]
                at = _first(t, last + self.ttl, lambda x, last=last: x - last >= self.ttl, at)
            if at >= len(t):
                return ok, kept
            ok[at], kept, at = True, [float(t[at])], at + 1

    def over(self, kept: list[float]) -> float:
        return kept[0] + self.ttl


class Throttled:
    """At most ``limit`` accepted rows within ``window``; rejected ones do not count."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def decide(self, kept: list[float], t: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, list[float]]:
        ok, at = np.zeros(len(t), bool), 0
        while self.limit > 0 and at < len(t):
            if len(kept) >= self.limit:  # the oldest must have left the window
                oldest = kept[-self.limit]
                at = _first(t, oldest + self.window, lambda x, oldest=oldest: x - oldest > self.window, at)
                if at == len(t):
                    break
            kept = [*kept[1 - self.limit or len(kept) :], float(t[at])]
            ok[at], at = True, at + 1
        return ok, kept

    def over(self, kept: list[float]) -> float:
        return kept[-1] + self.window


class Cooled:
    """Usable from the deadline on; a row with a cooldown sets the deadline, at most ``cap`` ahead."""

    def __init__(self, cap: float):
        self.cap = cap

    def decide(self, kept: list[float], t: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, list[float]]:
        sets = ~np.isnan(extra)
        until = np.where(sets, t + np.minimum(self.cap, extra), -np.inf)
        last = np.maximum.accumulate(np.where(sets, np.arange(len(t)), -1))
        before = np.concatenate([[-1], last[:-1]])  # the deadline in force is that of the last row before
        return t >= np.where(before >= 0, until[before], kept[0] if kept else -np.inf), [float(until[last[-1]])] if last[-1] >= 0 else kept

    def over(self, kept: list[float]) -> float:
        return kept[0]


class _Keyed(StatefulProcessor):
    def __init__(self, rule, flag: str, extra: str | None, tell: bool):
        self.rule, self.flag, self.extra, self.tell = rule, flag, extra, tell

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "kept array<double>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(b["t"].to_numpy(np.float64), b["ord"].to_numpy(), b[self.extra].to_numpy(np.float64) if self.extra else None) for b in rows]
        t, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.lexsort((place, t))
        t, extra = t[by], np.concatenate([p[2] for p in parts])[by] if self.extra else None
        kept, timer = list(self.held.get()) if self.held.exists() else ([], None)
        ok, kept = self.rule.decide([float(x) for x in kept], t, extra)
        if kept:
            due = max(1, math.ceil(self.rule.over(kept) * 1000))
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.held.update((kept, due))
        for i in range(0, len(t), _ROWS_OUT):
            part = slice(i, i + _ROWS_OUT)
            yield pd.DataFrame({"key": key[0], "t": t[part], self.flag: ok[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            self.held.clear()
            if self.tell:
                yield pd.DataFrame({"key": [key[0]], "t": [expiredTimerInfo.getExpiryTimeInMs() / 1000], self.flag: pd.array([None], "boolean")})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, rule, flag: str, late: str, tell: bool, extra: str | None = None) -> DataFrame:
    cols = [F.col(key).cast("string").alias("key"), F.col("t").cast("double").alias("t"), "ord", *[F.col(c).cast("double").alias(c) for c in [extra] if c]]
    placed = rows.select(*cols).where("t is not null").withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    return placed.groupBy("key").transformWithStateInPandas(_Keyed(rule, flag, extra, tell), f"key string, t double, {flag} boolean", "append", "EventTime")


def due(rows: DataFrame, key: str, ttl: float = Config.ttl_seconds, late: str = "1 hour", tell_idle: bool = False) -> DataFrame:
    """(key, t, accepted) of (key, t, ord): accepted if never before, or ``ttl`` after the last accepted one.

    With ``tell_idle`` a row with a null ``accepted`` says when a key's state left.
    """
    return _run(rows, key, Due(ttl), "accepted", late, tell_idle)


def throttled(rows: DataFrame, key: str, limit: int = Config.rate_limit, window: float = Config.rate_window_seconds, late: str = "1 hour", tell_idle: bool = False) -> DataFrame:
    """(key, t, accepted) of (key, t, ord): at most ``limit`` accepted rows within ``window``; rejected ones do not count."""
    return _run(rows, key, Throttled(limit, window), "accepted", late, tell_idle)


def cooled(rows: DataFrame, key: str, cap: float = Config.cooldown_cap_seconds, late: str = "1 hour", tell_idle: bool = False) -> DataFrame:
    """(key, t, usable) of (key, t, ord, cooldown): a row with a cooldown sets the deadline, at most ``cap`` ahead."""
    return _run(rows, key, Cooled(cap), "usable", late, tell_idle, "cooldown")
