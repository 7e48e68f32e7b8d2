"""Keyed time state as arbitrary stateful streaming: time to live, sliding-window throttle, cooldown.

Rows of a key are taken in time order within a micro-batch.  State is one value (or at most ``limit``
values) a key.  In a continuous run give ``keep_seconds``, after which idle state leaves; a run that ends
(``availableNow``) takes none, because a processing-time timeout keeps such a run going.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.config import Config


def _stateful(rows: DataFrame, key: str, extra: str, decide, state: str, keep_seconds: float | None) -> DataFrame:
    out = f"key string, t double, {extra}"
    names = [c.split()[0] for c in out.split(", ")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        kept = list(held.get[0]) if held.exists else []
        every = pd.concat(list(batches), ignore_index=True).sort_values(["t", "ord"], kind="stable")
        result = []
        for r in every.itertuples(index=False):
            kept, *found = decide(kept, r)
            result.append((group[0], r.t, *found))
        held.update((kept,))
        if keep_seconds is not None:
            held.setTimeoutDuration(int(max(1.0, keep_seconds) * 1000))
        yield pd.DataFrame(result, columns=names)

    timeout = GroupStateTimeout.NoTimeout if keep_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.withColumn("key", F.col(key).cast("string")).groupBy("key").applyInPandasWithState(run, out, state, "append", timeout)


def due(rows: DataFrame, key: str, ttl: float = Config.ttl_seconds, keep_seconds: float | None = None) -> DataFrame:
    """(key, t, accepted) of (key, t, ord): accepted if never before, or ``ttl`` after the last accepted one."""

    def decide(kept, r):
        ok = not kept or r.t - kept[0] >= ttl
        return ([float(r.t)] if ok else kept), ok

    return _stateful(rows, key, "accepted boolean", decide, "kept array<double>", keep_seconds)


def throttled(rows: DataFrame, key: str, limit: int = Config.rate_limit, window: float = Config.rate_window_seconds, keep_seconds: float | None = None) -> DataFrame:
    """(key, t, accepted) of (key, t, ord): at most ``limit`` accepted rows within ``window``; rejected ones do not count."""

    def decide(kept, r):
        kept = [x for x in kept if r.t - x <= window]
        ok = len(kept) < limit
        return (kept + [float(r.t)] if ok else kept), ok

    return _stateful(rows, key, "accepted boolean", decide, "kept array<double>", keep_seconds)


def cooled(rows: DataFrame, key: str, cap: float = Config.cooldown_cap_seconds, keep_seconds: float | None = None) -> DataFrame:
    """(key, t, usable) of (key, t, ord, cooldown): a row with a cooldown sets the deadline, at most ``cap`` ahead."""

    def decide(kept, r):
        usable = not kept or r.t >= kept[0]
        if r.cooldown is not None and r.cooldown == r.cooldown:
            kept = [float(r.t + min(cap, r.cooldown))]
        return kept, usable

    return _stateful(rows, key, "usable boolean", decide, "kept array<double>", keep_seconds)


def windowed_counts(rows: DataFrame, at: str, by: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Event-time counts in tumbling or sliding windows, with late rows up to the watermark."""
    marked = rows.withWatermark(at, late)
    return marked.groupBy(F.window(at, length, slide or length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(rows: DataFrame, at: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Event-time sessions by key."""
    marked = rows.withWatermark(at, late)
    return marked.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
