"""Shared storage for intermediate tables: cut lineage by writing, never by localCheckpoint."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local (tests) a temporary folder is made and set, so that later calls agree; on a
    cluster an unset folder is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = found or "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, root = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []


def finished_parts(spark: SparkSession, path: str, name: str = "part") -> list[int]:
    """Numbers of the folders ``name``=n under ``path`` that were written to their end, ascending."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(x.getName()[len(name) + 1 :]) for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


#: Spilled tables of this process that are still there.
_LEFT: list[Spill] = []


def drop_spills() -> int:
    """Deletes all spilled tables of this process, when nothing that was computed from them will be read again."""
    left = list(_LEFT)
    for table in left:
        table.drop()
    return len(left)


class Spill:
    """A table written once to the shared folder. ``df`` reads it; ``drop`` deletes it when no plan needs it any more."""

    def __init__(self, df: DataFrame, name: str = "t", codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/weftline-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        _LEFT.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        fs, path = _fs(self.spark, self.path)
        fs.delete(path, True)
        if self in _LEFT:
            _LEFT.remove(self)


@contextmanager
def record_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows at most for what is written inside: for rows that hold long texts more than once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for explicit repartition() of tables that AQE would fold into one task."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
