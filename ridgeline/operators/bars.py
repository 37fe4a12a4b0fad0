"""Activity bars: a scan whose running sum restarts at each threshold crossing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN = {"volume": "volume", "trade": "no_of_trades", "liquidity": "liquidity_sum"}


def restarting(values: np.ndarray, threshold: float, total: float = 0.0, group: int = 0) -> tuple[np.ndarray, float, int]:
    """The group of each row, and the running sum and group after the last one; what lies above the threshold is not carried over."""
    groups = np.empty(len(values), np.int64)
    at, reach = 0, 64
    while at < len(values):
        sums = np.cumsum(np.concatenate([[total], values[at : at + reach]]))[1:]
        over = int((sums >= threshold).argmax())
        if sums[over] >= threshold:
            groups[at : at + over + 1] = group
            at, total, group, reach = at + over + 1, 0.0, group + 1, max(64, 2 * over)
        else:
            groups[at : at + len(sums)] = group
            at, total, reach = at + len(sums), float(sums[-1]), 2 * reach
    return groups, total, group


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """The rows at which the key differs from the row before, the first row among them."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def bar_groups(df: DataFrame, threshold: float, column: str, keys: tuple[str, ...] = ("series",), order: str = "datetime") -> DataFrame:
    """Add bar_group, and __row: the number of the row within the key, from 1.

    The restart depends on the state, so each key is one ordered scan, in Arrow batches; kept between them: key, sum, group and number.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("bar_group", T.LongType()), T.StructField("__row", T.LongType())])
    at, of = df.columns.index(column), [df.columns.index(k) for k in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, group, n = None, 0.0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            groups, numbers = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
            starts = _starts([batch.column(i) for i in of])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
                key = tuple(batch.column(i)[lo].as_py() for i in of)
                if key != now:
                    now, total, group, n = key, 0.0, 0, 0
                groups[lo:hi], total, group = restarting(values[lo:hi], threshold, total, group)
                numbers[lo:hi] = np.arange(n + 1, n + 1 + hi - lo)
                n += hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups), pa.array(numbers)], names=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(scan, schema)


def activity_bars(df: DataFrame, threshold: float, column: str, keys: tuple[str, ...] = ("series",), order: str = "datetime") -> DataFrame:
    """Bars of klines; the last one is left out if it stays below the threshold.

    base_interval: seconds between a key's first two rows, 0 with one row. The klines are read once.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    second = lambda n: F.min(F.when(F.col("__row") == n, F.unix_micros(F.col(order).cast("timestamp"))))
    weighted = lambda c: (F.sum(F.col(c) * F.col("no_of_trades")) / F.sum("no_of_trades")).alias(c)
    bars = bar_groups(df, threshold, column, keys, order).groupBy(*keys, "bar_group").agg(
        F.min(order).alias("datetime"), F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"), F.sum("no_of_trades").alias("no_of_trades"), F.sum("liquidity_sum").alias("liquidity_sum"), weighted("maker_ratio"),
        F.sum("maker_volume").alias("maker_volume"), F.sum("maker_liquidity").alias("maker_liquidity"), weighted("mean"), F.count("*").alias("bar_count"), F.sum(column).alias("__full"),
        second(1).alias("__first"), second(2).alias("__second"),
    )
    w = Window.partitionBy(*keys)
    base = F.coalesce((F.max("__second").over(w) - F.max("__first").over(w)) / 1e6, F.lit(0.0))
    return bars.withColumn("base_interval", base).where(F.col("__full") >= threshold).drop("__full", "__first", "__second", "bar_group")


def compute_bars(df: DataFrame, bar_type: str, threshold: float | None = None, **options) -> DataFrame:
    """bar_type volume, trade or liquidity; base or another name leaves the frame as it is."""
    if bar_type not in COLUMN:
        return df
    if threshold is None:
        raise ValueError(f"{bar_type} bars need a threshold")
    return activity_bars(df, threshold, COLUMN[bar_type], **options)
