"""Features of spans (start and end row numbers) over numbered rows, as running sums and as-of lookups.

rows: keys..., i (row number from 0). spans: keys..., start_idx, end_idx. Spans that
begin or end outside the rows count too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _open_spans(rows: DataFrame, spans: DataFrame, name: str, keys: tuple[str, ...], after_end: int) -> DataFrame:
    steps = spans.select(*keys, F.col("start_idx").alias("i"), F.lit(1).alias("d")).union(spans.select(*keys, (F.col("end_idx") + after_end).alias("i"), F.lit(-1).alias("d")))
    steps = steps.groupBy(*keys, "i").agg(F.sum("d").alias("d")).withColumn("__row", F.lit(False))
    both = rows.withColumn("__row", F.lit(True)).unionByName(steps, allowMissingColumns=True)
    so_far = F.sum("d").over(Window.partitionBy(*keys).orderBy("i").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, F.greatest(F.coalesce(so_far, F.lit(0)), F.lit(0))).where("__row").drop("d", "__row")


def active_lines(rows: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Spans that hold the row, their end included."""
    return _open_spans(rows, spans, "active_lines", keys, 1)


def active_quantile_count(rows: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Spans that hold the row, their end excluded."""
    return _open_spans(rows, spans, "active_quantile_count", keys, 0)


def _last_end(rows: DataFrame, spans: DataFrame, keys: tuple[str, ...], same_row: bool) -> DataFrame:
    """Add __end: the latest end before each row, or at it if same_row."""
    ends = spans.select(*keys, F.col("end_idx").alias("i"), F.col("end_idx").alias("__e")).distinct().withColumn("__tag", F.lit(0 if same_row else 2))
    both = rows.withColumn("__tag", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("i", "__tag").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__end", F.last("__e", ignorenulls=True).over(w)).where("__tag = 1").drop("__e", "__tag")


def _since(df: DataFrame, name: str, lookback: int) -> DataFrame:
    passed: Column = F.col("i") - F.col("__end")
    return df.withColumn(name, F.least(F.coalesce(passed, F.lit(lookback)), F.lit(lookback))).drop("__end")


def hours_since_big_move(rows: DataFrame, spans: DataFrame, lookback: int = 168, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows since the latest end strictly before; at most lookback."""
    return _since(_last_end(rows, spans, keys, False), "hours_since_big_move", lookback)


def hours_since_quantile_line(rows: DataFrame, spans: DataFrame, lookback: int = 168, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows since the latest end, one at the row included; at most lookback."""
    return _since(_last_end(rows, spans, keys, True), "hours_since_quantile_line", lookback)


def quantile_line_density(rows: DataFrame, spans: DataFrame, lookback: int = 48, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Ends within the last lookback rows, the row itself included."""
    ends = spans.groupBy(*keys, F.col("end_idx").alias("i")).agg(F.count("*").alias("__n")).withColumn("__row", F.lit(False))
    both = rows.withColumn("__row", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("i").rangeBetween(-lookback, 0)
    return both.withColumn("quantile_line_density_48h", F.coalesce(F.sum("__n").over(w), F.lit(0))).where("__row").drop("__n", "__row")
