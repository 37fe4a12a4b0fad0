"""Klines: trades in fixed time buckets, one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import q_exact, q_ranked

C = F.col
#: Decimals in presentation.
DECIMALS = {"mean": 5, "std": 6, "volume": 9, "liquidity_sum": 1, "maker_liquidity": 1}
QUANTILES = ("counted", "list", "ranked", "none")
#: The columns in their order, after keys and datetime.
COLUMNS = (
    "open", "high", "low", "close", "mean", "std", "median", "iqr", "volume", "maker_ratio", "no_of_trades", "open_liquidity", "high_liquidity", "low_liquidity", "close_liquidity", "liquidity_sum", "maker_volume", "maker_liquidity",
)


def bucket(seconds: int, ts: str = "datetime") -> Column:
    """Start of the epoch-aligned bucket."""
    return F.window(ts, f"{seconds} seconds").start


def price_sums() -> list[Column]:
    """What the trades of one price in a bucket add up to; all of it merges."""
    value, maker = C("price") * C("quantity"), C("is_buyer_maker").cast("int")
    known = F.when(C("trade_id").isNotNull(), F.struct("trade_id", "price", value.alias("value")))
    return [
        F.count("*").alias("n"), F.count(maker).alias("n_maker"), F.min(known).alias("first"), F.max(known).alias("last"), F.sum("quantity").alias("volume"), F.sum(maker).alias("makers"), F.max(value).alias("high_liquidity"),
        F.min(value).alias("low_liquidity"), F.sum(value).alias("liquidity_sum"), F.sum(maker * C("quantity")).alias("maker_volume"), F.sum(maker * value).alias("maker_liquidity"),
    ]


def merged_sums() -> dict[str, Column]:
    """Columns of klines from the sums by price, but for those that need the prices in order."""
    first, last = F.min("first"), F.max("last")
    return {
        "open": first["price"], "high": F.max("price"), "low": F.min("price"), "close": last["price"], "volume": F.sum("volume"), "maker_ratio": F.sum("makers").cast("double") / F.nullif(F.sum("n_maker"), F.lit(0)), "no_of_trades": F.sum("n"),
        "open_liquidity": first["value"], "high_liquidity": F.max("high_liquidity"), "low_liquidity": F.min("low_liquidity"), "close_liquidity": last["value"], "liquidity_sum": F.sum("liquidity_sum"),
        "maker_volume": F.sum("maker_volume"), "maker_liquidity": F.sum("maker_liquidity"),
    }


def _counted(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """All columns from counts by price: a bucket's rows are merged before the shuffle, its prices are ranked by a sort that spills."""
    by = [*keys, "__b"]
    prices = trades.groupBy(*by, "price").agg(*price_sums())
    whole, n = Window.partitionBy(*by), F.when(C("price").isNotNull(), C("n")).otherwise(0)
    upto = whole.orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    ranked = prices.withColumns({"__upto": F.sum(n).over(upto), "__all": F.sum(n).over(whole), "__total": F.sum(n * C("price")).over(whole)})
    mean = C("__total") / F.nullif(C("__all"), F.lit(0))
    at = lambda q: F.min(F.when(C("__upto") > F.least(F.floor(C("__all") * q), C("__all") - 1), C("price")))
    out = ranked.withColumn("__mean", mean).groupBy(*keys, C("__b").alias("datetime")).agg(
        *(c.alias(name) for name, c in merged_sums().items()), F.first("__mean").alias("mean"), F.sqrt(F.sum(n * (C("price") - C("__mean")) * (C("price") - C("__mean"))) / F.nullif(F.sum(n), F.lit(0))).alias("std"),
        at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("iqr"),
    )
    return out.select(*keys, "datetime", *COLUMNS)


def klines(trades: DataFrame, kline_size: int = 3600, start: str | None = None, n_rows: int | None = None, latest: bool = False, keys: tuple[str, ...] = ("series",), quantiles: str = "counted") -> DataFrame:
    """Nineteen columns per bucket and key; empty buckets give no row.

    start: earliest bucket. n_rows: the oldest rows, or with latest=True the newest.
    quantiles, all of the same values: "counted" merges the trades of a price before the shuffle and ranks a bucket's prices, for
    buckets of any size; "list" gathers a bucket's prices (one shuffle; buckets of moderate size); "ranked" ranks every
    trade; "none" leaves median and iqr out.
    """
    if quantiles not in QUANTILES:
        raise ValueError(f"quantiles must be one of {QUANTILES}")
    if start is not None:
        trades = trades.where(C("datetime") >= F.lit(start).cast("timestamp_ntz"))
    trades = trades.withColumns({"__v": C("price") * C("quantity"), "__m": C("is_buyer_maker").cast("int"), "__b": bucket(kline_size)})
    if quantiles == "counted":
        return _limited(_counted(trades, keys), n_rows, latest, keys)
    price = C("price")
    low, mid, high = (q_exact(price, q) for q in (0.25, 0.5, 0.75))
    spread = [mid.alias("median"), (high - low).alias("iqr")] if quantiles == "list" else []
    out = trades.groupBy(*keys, C("__b").alias("datetime")).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"),
        F.avg("price").alias("mean"), F.stddev_pop("price").alias("std"), *spread, F.sum("quantity").alias("volume"), F.avg("__m").alias("maker_ratio"),
        F.count("*").alias("no_of_trades"), F.min_by("__v", "trade_id").alias("open_liquidity"), F.max("__v").alias("high_liquidity"), F.min("__v").alias("low_liquidity"),
        F.max_by("__v", "trade_id").alias("close_liquidity"), F.sum("__v").alias("liquidity_sum"), F.sum(C("__m") * C("quantity")).alias("maker_volume"), F.sum(C("__m") * C("__v")).alias("maker_liquidity"),
    )
    if quantiles == "ranked":
        q = q_ranked(trades.withColumnRenamed("datetime", "__t").withColumnRenamed("__b", "datetime"), [*keys, "datetime"], "price", {"__q1": 0.25, "median": 0.5, "__q3": 0.75}, "exact")
        out = out.join(q, [*keys, "datetime"]).withColumn("iqr", C("__q3") - C("__q1")).drop("__q1", "__q3")
    return _limited(out, n_rows, latest, keys)


def _limited(out: DataFrame, n_rows: int | None, latest: bool, keys: tuple[str, ...]) -> DataFrame:
    if n_rows is None:
        return out
    return out.orderBy(C("datetime").desc() if latest else C("datetime").asc(), *keys).limit(n_rows)


SUMMARY = ("open", "high", "low", "close", "volume", "liquidity_sum", "maker_ratio", "no_of_trades")


def _summary() -> list[Column]:
    return [
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"), F.sum("quantity").alias("volume"),
        F.sum(C("price") * C("quantity")).alias("liquidity_sum"), F.avg(C("is_buyer_maker").cast("int")).alias("maker_ratio"), F.count("*").alias("no_of_trades"),
    ]


def sliding(trades: DataFrame, size: int, slide: int, keys: tuple[str, ...] = ("series",), delay: str | None = None) -> DataFrame:
    """Summaries of overlapping windows: keys, datetime (start), end and eight columns. Windows start at multiples of `slide` seconds.

    delay: of a stream's late rows; its state is a row for each open window, size / slide of them at a time.
    """
    if not 0 < slide <= size:
        raise ValueError("need 0 < slide <= size")
    rows = trades if delay is None else trades.withWatermark("datetime", delay)
    return rows.groupBy(*keys, F.window("datetime", f"{size} seconds", f"{slide} seconds").alias("w")).agg(*_summary()).select(*keys, C("w.start").alias("datetime"), C("w.end").alias("end"), *SUMMARY)


def sessions(trades: DataFrame, gap: int, keys: tuple[str, ...] = ("series",), delay: str | None = None) -> DataFrame:
    """Summaries of sessions, which end when no trade comes for `gap` seconds: keys, datetime (first trade), end (last trade and gap) and eight columns.

    delay: of a stream's late rows; its state is a row for each open session.
    """
    rows = trades if delay is None else trades.withWatermark("datetime", delay)
    return rows.groupBy(*keys, F.session_window("datetime", f"{gap} seconds").alias("w")).agg(*_summary()).select(*keys, C("w.start").alias("datetime"), C("w.end").alias("end"), *SUMMARY)


def presented(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in DECIMALS.items() if c in df.columns})
