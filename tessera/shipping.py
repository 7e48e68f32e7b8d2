"""What a session needs for functions in Python workers: this package, and batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of rows that Spark hands to a Python worker at once, so that long texts do not add up.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send a zip of the package to the workers, once an application.

    Functions that run in Python workers are pickled by reference, so the workers must be able
    to import it.  Without effect where the package comes from a shared installation.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
