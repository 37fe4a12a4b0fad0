"""Trades: schemas, readers, and adapters from other tables.

The canonical trades table: series, trade_id, datetime, timestamp (ms), price,
quantity, is_buyer_maker.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names of the three raw tables. Fixed values.
RAW_SCHEMAS = {
    "spot_trades": "trade_id long, price double, quantity double, quote_quantity double, timestamp long, is_buyer_maker boolean, best_match boolean",
    "spot_agg_trades": "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, timestamp long, is_buyer_maker boolean, best_match boolean",
    "futures_trades": "trade_id long, price double, quantity double, quote_quantity double, timestamp long, is_buyer_maker boolean",
}


def milliseconds(ts: Column) -> Column:
    """Time stamps of 10**13 and more are microseconds."""
    return F.when(ts < 10**13, ts).otherwise(F.floor(ts / 1000))


def normalise(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """timestamp in ms, and datetime without a zone."""
    return df.withColumn(ts_col, milliseconds(F.col(ts_col))).withColumn("datetime", F.timestamp_millis(ts_col).cast("timestamp_ntz"))


def read_csv(spark: SparkSession, path: str, columns: str, has_header: bool = False) -> DataFrame:
    """CSV files with the given schema."""
    return normalise(spark.read.csv(path, schema=columns, header=has_header))


def read_zipped_csv(spark: SparkSession, path: str, columns: str, has_header: bool = False) -> DataFrame:
    """The first .csv of each zip file; the files are spread over tasks."""
    import pandas as pd

    schema = T._parse_datatype_string(columns) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], columns).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next(n for n in z.namelist() if n.endswith(".csv"))
                    yield from pd.read_csv(z.open(name), header=0 if has_header else None, names=schema.fieldNames(), chunksize=100_000)

    return normalise(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema))


def from_events(events: DataFrame, series: Column | None = None) -> DataFrame:
    """Events as trades; prices and quantities are shifted by one so that none is zero."""
    series = F.lit("all") if series is None else series
    quantity = F.get_json_object("props", "$.k").cast("double") + 1
    stamp = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(series.alias("series"), F.col("event_id").alias("trade_id"), F.col("ts").alias("datetime"), stamp.alias("timestamp"), (F.col("value") + 1).alias("price"), quantity.alias("quantity"), F.col("event_type").isin("purchase", "click").alias("is_buyer_maker"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order lines as daily trades by return flag. Lines have no unique key: the id is a digest of the whole line."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem.select(F.col("l_returnflag").alias("series"), F.xxhash64(*lineitem.columns).alias("trade_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), price.alias("price"), F.col("l_quantity").alias("quantity"), (F.col("l_linestatus") == "O").alias("is_buyer_maker"))


def select_trades(trades: DataFrame, month_year: tuple[int, int] | None = None, n_rows: int | None = None, n_random: int | None = None) -> DataFrame:
    """Exactly one of: a month, the latest rows, or a repeatable sample of rows."""
    if sum(x is not None for x in (month_year, n_rows, n_random)) != 1:
        raise ValueError("give exactly one of month_year, n_rows, n_random")
    if month_year is not None:
        month, year = month_year
        first = dt.datetime(year, month, 1)
        following = dt.datetime(year + month // 12, month % 12 + 1, 1)
        return trades.where((F.col("datetime") >= F.lit(first).cast("timestamp_ntz")) & (F.col("datetime") < F.lit(following).cast("timestamp_ntz")))
    if n_rows is not None:
        return trades.orderBy(F.date_trunc("day", "datetime").desc(), F.col("trade_id").desc()).limit(n_rows)
    return trades.orderBy(F.md5(F.concat_ws(":", "trade_id", "timestamp").cast("binary")), "trade_id").limit(n_random)


def write_log(df: DataFrame, path: str, fmt: str = "parquet", run: str | None = None) -> None:
    """Append an experiment's log (parquet or csv); as a table: saveAsTable on the same frame.

    run: the rows go to a partition `run` of this name and replace what an earlier try of the same run has left there, so that a repeated job adds nothing.
    """
    if run is None:
        writer = df.write.mode("append").format(fmt)
    else:
        writer = df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def batch_log(path: str, fmt: str = "parquet", run: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of logs: each batch is a run of its own, written once however often it is tried."""
    return lambda df, batch: write_log(df, path, fmt, f"{run}-{batch}")


def to_sqlite(log: DataFrame, path: str, table: str, run: str | None = None) -> None:
    """Append an experiment's log, which has a row per round, to a table of an SQLite file on the driver; rows come one partition at a time.

    run: a column of this name and value; what the run has written before is replaced, in one transaction.
    """
    log = log if run is None else log.withColumn("run", F.lit(run))
    with contextlib.closing(sqlite3.connect(path)) as con, con:
        names = ", ".join(f'"{c}"' for c in log.columns)
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
        if run is not None:
            con.execute(f'DELETE FROM "{table}" WHERE run = ?', (run,))
        con.executemany(f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(log.columns))})', (tuple(r) for r in log.toLocalIterator()))


def read_log(spark: SparkSession, path: str, schema: str, marker: str = "recall") -> DataFrame:
    """A CSV log; repeated header lines (they start with the marker) are dropped and strings trimmed."""
    lines = spark.read.text(path).where(~F.col("value").startswith(marker) & (F.trim("value") != ""))
    parsed = lines.select(F.from_csv("value", schema).alias("r")).select("r.*")
    return parsed.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in parsed.dtypes))
