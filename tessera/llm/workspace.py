"""Shared-folder tables that cut lineage.

Intermediate tables go below ``spark.checkpoint.dir`` of the session, which every executor and the
driver can reach.  Only where that is unset and the master is this machine (tests, a laptop) is a
folder made here; on a cluster it must be named.  Operators drop tables that nothing reads any more,
``scratch`` drops all of a block, and what a result still reads goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.streaming.runs import on_one_machine

_blocks: list[list[Workspace]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """A folder of intermediate tables for one run of an operator, deleted when the application ends.

    With ``path`` it is that folder, and stays.
    """

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}").rstrip("/")
        if path is None:
            store, place = self._store("")
            store.deleteOnExit(place)
            if _blocks:
                _blocks[-1].append(self)

    def _store(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends at the files."""
        where = f"{self.path}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Delete tables, or without a name the whole folder; a missing one is no error."""
        for name in names or ("",):
            store, place = self._store(name)
            store.delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Workspaces made inside are deleted at the end: write down what is to stay before."""
    made: list[Workspace] = []
    _blocks.append(made)
    try:
        yield
    finally:
        _blocks.remove(made)
        for space in made:
            space.drop()


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
