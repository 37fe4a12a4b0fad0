"""Tables written once in the folder that all executors share: iterations read them instead of a growing plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. A local session gets a folder of its own where none is set; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ridgeline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Staged:
    """A table written once. df reads it; drop() deletes it, else it goes with the session."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        at, store = _at(self.spark, self.path)
        store.deleteOnExit(at)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at, store = _at(self.spark, self.path)
        store.delete(at, True)
