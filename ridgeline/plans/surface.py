"""Operators for plain SQL: table functions over partitions in order, and views of klines.

    register(spark)
    kline_view(spark, trades, "hourly")
    SELECT * FROM activity_bars(TABLE(hourly) PARTITION BY series ORDER BY (datetime), 2000D, 'volume')
    SELECT * FROM sequential_backtest(TABLE(predictions) PARTITION BY round_id ORDER BY (datetime), 30000D, 0.001D)

A partition's rows come to one task in order, one by one; what it holds is an open bar, or the rows of the backtest that trade.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ridgeline.operators.bars import COLUMN
from ridgeline.operators.klines import klines

_SUMS, _MEANS = ("volume", "no_of_trades", "liquidity_sum", "maker_volume", "maker_liquidity"), ("maker_ratio", "mean")
_RESULTS = ("pnl", "win_rate", "max_drawdown", "expected_value", "sharpe_ratio", "net_long_volume", "net_short_volume", "net_trade_volume")


class ActivityBars:
    """Bars of a partition of klines, as operators.bars.activity_bars makes them, each when it is full."""

    @staticmethod
    def analyze(row: AnalyzeArgument, threshold: AnalyzeArgument, bar_type: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql import types as T

        if bar_type.value not in COLUMN or threshold.value is None or threshold.value <= 0:
            raise ValueError("the type is volume, trade or liquidity, and the threshold positive")
        key, time = row.dataType["series"], row.dataType["datetime"]
        numbers = [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", *_SUMS, *_MEANS)]
        return AnalyzeResult(T.StructType([key, time, *numbers, T.StructField("bar_count", T.LongType()), T.StructField("base_interval", T.DoubleType())]))

    def __init__(self):
        self.bar, self.full, self.first, self.base, self.total = None, [], None, None, 0.0

    def eval(self, row: Row, threshold: float, bar_type: str) -> Iterator[tuple]:
        if self.first is None:
            self.first = row["datetime"]
        elif self.base is None:
            self.base = (row["datetime"] - self.first).total_seconds()
        if self.bar is None:
            self.bar = {"series": row["series"], "datetime": row["datetime"], "open": row["open"], "high": row["high"], "low": row["low"], "n": 0} | dict.fromkeys((*_SUMS, *_MEANS), 0.0)
        bar = self.bar
        bar |= {"high": max(bar["high"], row["high"]), "low": min(bar["low"], row["low"]), "close": row["close"], "n": bar["n"] + 1}
        for c in _SUMS:
            bar[c] += float(row[c] or 0)
        for c in _MEANS:
            bar[c] += float(row[c] or 0) * row["no_of_trades"]
        self.total += float(row[COLUMN[bar_type]] or 0)
        if self.total >= threshold:
            self.full.append(bar)
            self.bar, self.total = None, 0.0
        if self.base is not None:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple]:
        """The bars that are full: those of the first row wait for the second, which gives the base interval."""
        for b in self.full:
            means = [b[c] / b["no_of_trades"] if b["no_of_trades"] else None for c in _MEANS]
            yield (b["series"], b["datetime"], b["open"], b["high"], b["low"], b["close"], *(b[c] for c in _SUMS), *means, b["n"], float(self.base or 0.0))
        self.full = []


class SequentialBacktest:
    """The account of a partition of predictions, as operators.evaluation.sequential_backtest keeps it; one row."""

    @staticmethod
    def analyze(row: AnalyzeArgument, start: AnalyzeArgument, fee: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql import types as T

        return AnalyzeResult(T.StructType([row.dataType["round_id"], *(T.StructField(n, T.DoubleType()) for n in _RESULTS)]))

    def __init__(self):
        self.rows, self.key, self.start, self.fee = [], None, 0.0, 0.0

    def eval(self, row: Row, start: float, fee: float) -> None:
        self.key, self.start, self.fee = (row["round_id"],), float(start), float(fee)
        if row["prediction"] == 1:
            self.rows.append((1, row["open"], row["close"]))

    def terminate(self) -> Iterator[tuple]:
        from ridgeline.operators.ledger import run_backtest

        if self.key is not None:
            found = run_backtest(*(list(c) for c in zip(*self.rows, strict=True)), self.start, self.fee) if self.rows else dict.fromkeys(_RESULTS, 0.0)
            yield (*self.key, *(float(found[n]) for n in _RESULTS))


def register(spark: SparkSession) -> None:
    """activity_bars and sequential_backtest for SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("activity_bars", udtf(ActivityBars))
    spark.udtf.register("sequential_backtest", udtf(SequentialBacktest))


def kline_view(spark: SparkSession, trades: DataFrame, name: str, seconds: int = 3600) -> None:
    """Klines of a trades table as a view."""
    klines(trades, seconds).createOrReplaceTempView(name)
