"""Technical indicators. Each takes (df, s: Series, parameters) and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, clip, fdiv

S = Series()


def true_range(s: Series, high: str = "high", low: str = "low", close: str = "close") -> Column:
    """greatest() skips the null of the first row, where the range is high - low."""
    before = s.lag(close)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def atr(df: DataFrame, s: Series = S, high_col: str = "high", low_col: str = "low", close_col: str = "close", period: int = 14) -> DataFrame:
    df = df.withColumn("__tr", true_range(s, high_col, low_col, close_col))
    return s.with_ewm(df, {f"atr_{period}": ("__tr", 1.0 / period)}).drop("__tr")


def body_pct(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("body_pct", fdiv(F.col("close") - F.col("open"), "open"))


def bollinger_bands(df: DataFrame, s: Series = S, price_col: str = "close", window: int = 20, num_std: float = 2.0) -> DataFrame:
    mid, width = s.mean(price_col, window), s.std(price_col, window) * num_std
    return df.withColumns({"bb_middle": mid, "bb_upper": mid + width, "bb_lower": mid - width})


def bollinger_position(df: DataFrame, s: Series = S) -> DataFrame:
    """Needs bb_upper and bb_lower."""
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumn("bollinger_position", clip(F.when(width < 1e-6, 0.5).otherwise(fdiv(F.col("close") - F.col("bb_lower"), width)), 0, 1))


def cci(df: DataFrame, s: Series = S, window: int = 14) -> DataFrame:
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("__mean", s.mean("__tp", window))
    dev = s.mean(F.abs(F.col("__tp") - F.col("__mean")), window)
    return df.withColumn("cci", fdiv(F.col("__tp") - F.col("__mean"), dev * 0.015)).drop("__tp", "__mean")


def _span(period: int) -> float:
    return 2.0 / (period + 1)


def macd(df: DataFrame, s: Series = S, close_col: str = "close", fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> DataFrame:
    line, signal = f"macd_{fast_period}_{slow_period}", f"macd_signal_{signal_period}"
    df = s.with_ewm(df, {"__f": (close_col, _span(fast_period)), "__s": (close_col, _span(slow_period))})
    df = s.with_ewm(df.withColumn(line, F.col("__f") - F.col("__s")).drop("__f", "__s"), {signal: (line, _span(signal_period))})
    return df.withColumn("macd_hist", F.col(line) - F.col(signal))


def ppo(df: DataFrame, s: Series = S, close_col: str = "close", fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> DataFrame:
    line, signal = f"ppo_{fast_period}_{slow_period}", f"ppo_signal_{signal_period}"
    df = s.with_ewm(df, {"__f": (close_col, _span(fast_period)), "__s": (close_col, _span(slow_period))})
    df = df.withColumn(line, fdiv(F.col("__f") - F.col("__s"), "__s") * 100).drop("__f", "__s")
    df = s.with_ewm(df, {signal: (line, _span(signal_period))})
    return df.withColumn("ppo_hist", F.col(line) - F.col(signal))


def price_change_pct(df: DataFrame, s: Series = S, period: int = 1) -> DataFrame:
    return df.withColumn(f"price_change_pct_{period}", s.change("close", period) * 100)


def returns(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("returns", s.change("close"))


def roc(df: DataFrame, s: Series = S, col: str = "close", period: int = 12) -> DataFrame:
    return df.withColumn(f"roc_{period}", s.change(col, period) * 100)


def rolling_volatility(df: DataFrame, s: Series = S, column: str = "close", window: int = 12) -> DataFrame:
    return df.withColumn(f"{column}_volatility_{window}", s.std(column, window))


def _gain_and_loss(s: Series) -> tuple[Column, Column]:
    """Of the first row both are 0."""
    step = F.col("close") - s.lag("close")
    return F.when(step > 0, step).otherwise(0.0), F.when(step < 0, -step).otherwise(0.0)


def rsi_sma(df: DataFrame, s: Series = S, period: int = 14) -> DataFrame:
    gain, loss = _gain_and_loss(s)
    df = df.withColumns({"__g": gain, "__l": loss})
    ratio = fdiv(s.mean("__g", period), s.mean("__l", period) + 1e-10)
    return df.withColumn(f"rsi_sma_{period}", 100 - fdiv(F.lit(100.0), 1 + ratio)).drop("__g", "__l")


def sma(df: DataFrame, s: Series = S, column: str = "close", period: int = 20) -> DataFrame:
    return df.withColumn(f"{column}_sma_{period}", s.mean(column, period))


def sma_deviation_std(df: DataFrame, s: Series = S, period: int = 30, window: int = 30) -> DataFrame:
    df = df.withColumn("__dev", F.col("close") - s.mean("close", period))
    return df.withColumn(f"sma{period}_dev_std", s.std("__dev", window)).drop("__dev")


def stochastic_oscillator(df: DataFrame, s: Series = S, window_k: int = 14, window_d: int = 3) -> DataFrame:
    low, high = s.roll(F.min, "low", window_k), s.roll(F.max, "high", window_k)
    df = df.withColumn("stoch_k", fdiv(F.col("close") - low, high - low) * 100)
    return df.withColumn("stoch_d", s.mean("stoch_k", window_d))


def wilder_rsi(df: DataFrame, s: Series = S, period: int = 14) -> DataFrame:
    gain, loss = _gain_and_loss(s)
    df = s.with_ewm(df.withColumns({"__g": gain, "__l": loss}), {"__up": ("__g", 1.0 / period), "__down": ("__l", 1.0 / period)})
    return df.withColumn(f"wilder_rsi_{period}", 100 - fdiv(F.lit(100.0), 1 + fdiv("__up", "__down"))).drop("__g", "__l", "__up", "__down")


def window_return(df: DataFrame, s: Series = S, period: int = 24) -> DataFrame:
    return df.withColumn(f"ret_{period}", s.change("close", period))
