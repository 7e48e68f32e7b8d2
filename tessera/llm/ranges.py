"""Ranges of integer keys with about equal numbers of rows, for sorted layouts over many tasks.

The borders come from a sample of the keys, those with the smallest hashes, about ``SAMPLES`` a range;
so the driver holds a bounded number of keys, and all rows of a key lie in one range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 32
#: More ranges than this are not made; ranges grow instead, and sort with spilling.
MOST_RANGES = 1 << 17


def borders(rows: DataFrame, key: str, ranges: int, n: int) -> np.ndarray:
    """Ascending inner borders of at most ``ranges`` ranges of the ``n`` rows' keys: a key belongs to
    the range whose number is how many borders are at most the key.  Null keys are not looked at."""
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLES * ranges / max(1, n))
    few = F.xxhash64(F.col(key), F.lit(0x5EED)).bitwiseAND((1 << 53) - 1) <= int(share * ((1 << 53) - 1))
    picked = rows.where(F.col(key).isNotNull() & few).select(F.col(key).cast("long").alias("k")).toArrow()
    keys = np.sort(picked["k"].to_numpy())
    at = np.arange(1, ranges) * len(keys) // ranges
    return np.unique(keys[at]) if len(keys) else np.zeros(0, np.int64)
