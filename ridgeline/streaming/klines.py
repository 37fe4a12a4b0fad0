"""Klines of a stream of trades: watermarked tumbling windows, closed buckets appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators.klines import COLUMNS, merged_sums, price_sums

C = F.col


def _at(q: float) -> Column:
    """The price at index floor(q * n) of all trades, from the ordered prices and their counts."""
    index = F.least(F.floor(C("__all") * q), C("__all") - 1)
    step = lambda a, p: F.struct((a["upto"] + p["n"]).alias("upto"), F.when(a["upto"] <= index, p["price"]).otherwise(a["price"]).alias("price"))
    return F.aggregate("__prices", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("price")), step)["price"]


def stream_klines(trades: DataFrame, kline_size: int = 3600, delay: str = "10 minutes", keys: tuple[str, ...] = ("series",), quantiles: bool = True) -> DataFrame:
    """trades: a streaming frame whose datetime is a timestamp and whose prices are doubles.

    quantiles: with median and interquartile range, the same as in klines(). The state of an open bucket is then a row of sums for each distinct price,
    and not a row for each trade; the closed bucket's prices are put in order once. Without them it is one row.
    """
    w = F.window("datetime", f"{kline_size} seconds").alias("w")
    rows = trades.withWatermark("datetime", delay)
    if quantiles:
        prices = rows.groupBy(*keys, w, "price").agg(*price_sums()).withColumn("__end", F.window_time("w"))
        counts = F.array_sort(F.collect_list(F.when(C("price").isNotNull(), F.struct("price", "n"))))
        out = prices.groupBy(*keys, F.window("__end", f"{kline_size} seconds").alias("w")).agg(*(c.alias(name) for name, c in merged_sums().items()), counts.alias("__prices"))
        total = lambda f: F.aggregate("__prices", F.lit(0.0), lambda a, p: a + p["n"] * f(p["price"]))
        out = out.withColumn("__all", F.aggregate("__prices", F.lit(0).cast("long"), lambda a, p: a + p["n"])).withColumn("mean", total(lambda p: p) / F.nullif(C("__all"), F.lit(0)))
        spread = F.sqrt(total(lambda p: (p - C("mean")) * (p - C("mean"))) / F.nullif(C("__all"), F.lit(0)))
        out = out.withColumns({"std": spread, "median": _at(0.5), "iqr": _at(0.75) - _at(0.25)})
        return out.select(*keys, *(c for c in COLUMNS), C("w.start").alias("datetime"))
    value, maker = C("price") * C("quantity"), C("is_buyer_maker").cast("int")
    out = rows.groupBy(*keys, w).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"), F.avg("price").alias("mean"),
        F.stddev_pop("price").alias("std"), F.sum("quantity").alias("volume"), F.avg(maker).alias("maker_ratio"), F.count("*").alias("no_of_trades"),
        F.min_by(value, "trade_id").alias("open_liquidity"), F.max(value).alias("high_liquidity"), F.min(value).alias("low_liquidity"), F.max_by(value, "trade_id").alias("close_liquidity"), F.sum(value).alias("liquidity_sum"),
        F.sum(maker * C("quantity")).alias("maker_volume"), F.sum(maker * value).alias("maker_liquidity"),
    )
    return out.withColumn("datetime", C("w.start")).drop("w")


def start(klines: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed klines as Parquet; once: read what there is, then stop."""
    writer = klines.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
