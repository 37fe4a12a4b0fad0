"""Cutting lineage in the folder that all executors share, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session (as in tests) gets one where none is set; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ridgeline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _store(spark: SparkSession, path: str):
    """Hadoop's path and file system of a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written to this path and read from there from now on; the files go with the session."""
    df.write.option("compression", compression).parquet(path)
    at, store = _store(df.sparkSession, path)
    store.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there from now on.

    Uncompressed: hashes don't compress, and a codec's native buffers, one for each column and file, stay until
    the JVM collects its garbage.
    """
    return written(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}", "none")


#: Rows of an Arrow batch between the JVM and Python where the session leaves Spark's default: texts are long.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches, unless the session has set a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def kept_and(df: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    """The kept columns and then the text, under names of their own: for operators that go by position, whatever the columns are called."""
    small_batches(df.sparkSession)
    return df.select(*[df[c] for c in kept], df[text_col]).toDF(*(f"c{i}" for i in range(len(kept) + 1)))


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        at, store = _store(df.sparkSession, df._written)
        store.delete(at, True)


#: Looked-up ids are broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 8 << 20


def few(ids: DataFrame) -> DataFrame:
    """The written rows, measured: to be broadcast if they are small, else the join shuffles. 16 bytes a value besides strings' own."""
    size = sum((16 + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in ids.columns), F.lit(0))
    return F.broadcast(ids) if (ids.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else ids


def stars(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id of its connected component) of each id that has an edge and isn't the smallest itself; written.

    Alternates large-star and small-star rounds, O(log^2) of them, whose rows don't
    exceed the edges; no component is gathered in one place. The minimum of each id's
    neighbours is aggregated with partial sums and written before it is joined, so
    that Spark can split a hub's edges over tasks. Self-loops and repeated edges are allowed.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR (up = 1 AND n > 1)").isEmpty():  # only stars are left
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
        drop(e, least, large, lower)
        e = after
    raise RuntimeError("components did not converge")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (its smallest id) of each id that has an edge."""
    found = stars(edges, a, b)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
