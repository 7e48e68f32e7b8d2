"""Where streams keep their logs and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where none is named a folder on this machine serves a local master; on a cluster that is an error,
    because other machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not on_one_machine(spark):
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tessera-streams-")
    return _local[app]


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    where = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return where
