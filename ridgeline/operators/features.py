"""Features: projections, shifts, rolling and cumulative windows. Each takes (df, s: Series, parameters) and adds columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, clip, drop_null_rows, fdiv, flag
from ridgeline.operators.indicators import S, sma, true_range

C = F.col

# projections


def _within_range(df: DataFrame, name: str, tiny: float) -> DataFrame:
    return df.withColumn(name, fdiv(C("close") - C("low"), C("high") - C("low") + tiny))


def close_position(df: DataFrame, s: Series = S) -> DataFrame:
    return _within_range(df, "close_position", 1e-8)


def position_in_candle(df: DataFrame, s: Series = S) -> DataFrame:
    return _within_range(df, "position_in_candle", 1e-10)


def position_in_range(df: DataFrame, s: Series = S) -> DataFrame:
    return _within_range(df, "position_in_range", 1e-10)


def close_to_extremes(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumns({"close_to_high": fdiv(C("close") - C("high"), "high"), "close_to_low": fdiv(C("close") - C("low"), "low")})


def _relative_range(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, fdiv(C("high") - C("low"), "close"))


def range_pct(df: DataFrame, s: Series = S) -> DataFrame:
    return _relative_range(df, "range_pct")


def spread(df: DataFrame, s: Series = S) -> DataFrame:
    return _relative_range(df, "spread")


def spread_percent(df: DataFrame, s: Series = S) -> DataFrame:
    return _relative_range(df, "spread_percent")


def _scaled_volatility(df: DataFrame, name: str, base: float, multiplier: float, lo: float, hi: float) -> DataFrame:
    return df.withColumn(name, clip(C("volatility_measure") * multiplier * C("regime_multiplier"), base * lo, base * hi))


def dynamic_stop_loss(df: DataFrame, s: Series = S, base_stop_loss: float = 0.01, stop_volatility_multiplier: float = 1.0, clip_lower_mult: float = 0.7, clip_upper_mult: float = 1.4) -> DataFrame:
    return _scaled_volatility(df, "dynamic_stop_loss", base_stop_loss, stop_volatility_multiplier, clip_lower_mult, clip_upper_mult)


def dynamic_target(df: DataFrame, s: Series = S, base_min_breakout: float = 0.01, target_volatility_multiplier: float = 1.0, clip_lower_mult: float = 0.6, clip_upper_mult: float = 1.4) -> DataFrame:
    return _scaled_volatility(df, "dynamic_target", base_min_breakout, target_volatility_multiplier, clip_lower_mult, clip_upper_mult)


def exit_quality(df: DataFrame, s: Series = S, exit_quality_high: float = 1.0, exit_quality_low: float = 0.2, exit_quality_medium: float = 0.5) -> DataFrame:
    reason, gain = C("exit_reason"), C("exit_net_return")
    good = reason.isin("target_hit", "trailing_stop") & (gain > 0)
    bad = (reason == "stop_loss") | ((reason == "timeout") & (gain < 0))
    return df.withColumn("exit_quality", F.when(good, exit_quality_high).when(bad, exit_quality_low).otherwise(exit_quality_medium))


def regime_multiplier(df: DataFrame, s: Series = S, low: float = 0.8, normal: float = 1.0, high: float = 1.2) -> DataFrame:
    return df.withColumn("regime_multiplier", F.when(C("volatility_regime") == "low", low).when(C("volatility_regime") == "high", high).otherwise(normal))


def risk_reward_ratio(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("risk_reward_ratio", fdiv("capturable_breakout", F.abs("max_drawdown") + 0.001))


def volatility_measure(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("volatility_measure", (C("rolling_volatility") + C("atr_percent_sma")) / 2)


def volatility_1h(df: DataFrame, s: Series = S, column: str = "rolling_volatility") -> DataFrame:
    return df.withColumn("volatility_1h", C(column))


def feature_aliases(df: DataFrame, s: Series = S, base_min_breakout: float = 0.005, volatility_regime_enabled: bool = True) -> DataFrame:
    """Null (not NaN) becomes the default."""
    defaults = {"dynamic_target": base_min_breakout, "entry_score": 1.0, "momentum_score": 1.0}
    if volatility_regime_enabled:
        defaults |= {"vol_60h": 0, "vol_percentile": 50, "regime_low": 0, "regime_normal": 1, "regime_high": 0}
    return df.withColumns({f"{c}_feature": F.coalesce(C(c), F.lit(v)) for c, v in defaults.items()})


def time_features(df: DataFrame, s: Series = S) -> DataFrame:
    """weekday: Monday is 1."""
    return df.withColumns({"hour": F.hour("datetime"), "minute": F.minute("datetime"), "weekday": F.weekday("datetime") + 1})


def quantile_flag(df: DataFrame, s: Series = S, col: str = "close", cutoff: float = 0.0) -> DataFrame:
    return df.withColumn("quantile_flag", flag(C(col) > F.lit(cutoff)))


# shifts


def gap_high(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("gap_high", fdiv(C("high") - s.lag("close"), s.lag("close")))


def log_returns(df: DataFrame, s: Series = S, price_col: str = "close") -> DataFrame:
    ratio = fdiv(price_col, s.lag(price_col))
    return df.withColumn("log_returns", F.when(ratio == 0, float("-inf")).when(ratio < 0, float("nan")).otherwise(F.log(ratio)))


def lag_range_cols(df: DataFrame, s: Series = S, cols: Sequence[str] = ("close",), start: int = 1, end: int = 3) -> DataFrame:
    if isinstance(cols, str) or not cols:
        raise ValueError("cols must be a non-empty list of column names")
    if start < 1 or end < start:
        raise ValueError("lags must be positive and ascending")
    return df.withColumns({f"{c}_lag_{k}": s.lag(c, k) for c in cols for k in range(start, end + 1)})


def lag_range(df: DataFrame, s: Series = S, col: str = "close", start: int = 1, end: int = 3) -> DataFrame:
    return lag_range_cols(df, s, [col], start, end)


def lag_columns(df: DataFrame, s: Series = S, cols: Sequence[str] = ("close",), lag: int = 1) -> DataFrame:
    return df.withColumns({f"{c}_lag_{lag}": s.lag(c, lag) for c in cols})


def lag_column(df: DataFrame, s: Series = S, col: str = "close", lag: int = 1, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or f"{col}_lag_{lag}", s.lag(col, lag))


def returns_lags(df: DataFrame, s: Series = S, max_lag: int = 24, returns_col: str = "returns") -> DataFrame:
    if returns_col not in df.columns:
        df = df.withColumn(returns_col, s.change("close"))
    return lag_range(df, s, returns_col, 1, max_lag)


def micro_momentum(df: DataFrame, s: Series = S, period: int = 3) -> DataFrame:
    return df.withColumn("micro_momentum", s.change("close", period))


def momentum_periods(df: DataFrame, s: Series = S, periods: Sequence[int] = (12, 24, 48), price_col: str = "close") -> DataFrame:
    return df.withColumns({f"momentum_{p}": s.change(price_col, p) for p in periods})


def momentum_confirmation(df: DataFrame, s: Series = S, short_period: int = 1, long_period: int = 3, short_weight: float = 0.5) -> DataFrame:
    if short_period >= long_period:
        raise ValueError("short_period must be less than long_period")
    df = momentum_periods(df, s, (short_period, long_period))
    up = [flag(C(f"momentum_{p}") > 0) for p in (short_period, long_period)]
    return df.withColumn("momentum_score", up[0] * short_weight + up[1] * (1.0 - short_weight))


def momentum_weight(df: DataFrame, s: Series = S, period: int = 12, weight_multiplier: float = 0.5, base_weight: float = 0.5) -> DataFrame:
    return df.withColumn("momentum_weight", flag(s.change("close", period) > 0) * weight_multiplier + base_weight)


# rolling windows


def distance_from_high(df: DataFrame, s: Series = S, period: int = 24) -> DataFrame:
    return df.withColumn("distance_from_high", fdiv(s.roll(F.max, "high", period) - C("close"), "close"))


def distance_from_low(df: DataFrame, s: Series = S, period: int = 24) -> DataFrame:
    return df.withColumn("distance_from_low", fdiv(C("close") - s.roll(F.min, "low", period), "close"))


def price_range_position(df: DataFrame, s: Series = S, period: int = 24) -> DataFrame:
    lo, hi = s.roll(F.min, "low", period), s.roll(F.max, "high", period)
    return df.withColumn("price_range_position", fdiv(C("close") - lo, hi - lo + 1e-10))


def atr_sma(df: DataFrame, s: Series = S, period: int = 14) -> DataFrame:
    df = df.withColumn("__tr", true_range(s))
    return df.withColumn("atr_sma", s.mean("__tr", period)).drop("__tr")


def atr_percent_sma(df: DataFrame, s: Series = S, period: int = 14) -> DataFrame:
    df = df.withColumn("__tr", true_range(s))
    return df.withColumn("atr_percent_sma", fdiv(s.mean("__tr", period), "close")).drop("__tr")


def trend_strength(df: DataFrame, s: Series = S, fast_period: int = 20, slow_period: int = 50) -> DataFrame:
    slow = s.mean("close", slow_period)
    return df.withColumn("trend_strength", fdiv(s.mean("close", fast_period) - slow, slow))


def sma_ratios(df: DataFrame, s: Series = S, periods: Sequence[int] = (5, 10, 20, 50), price_col: str = "close") -> DataFrame:
    """Averages that are there already are used; all of them stay."""
    df = df.withColumns({f"{price_col}_sma_{p}": s.mean(price_col, p) for p in periods if f"{price_col}_sma_{p}" not in df.columns})
    return df.withColumns({f"sma_{p}_ratio": fdiv(price_col, f"{price_col}_sma_{p}") for p in periods})


def volume_ratio(df: DataFrame, s: Series = S, period: int = 20) -> DataFrame:
    if f"volume_sma_{period}" not in df.columns:
        df = sma(df, s, "volume", period)
    return df.withColumn("volume_ratio", fdiv("volume", f"volume_sma_{period}"))


def volume_trend(df: DataFrame, s: Series = S, short_period: int = 12, long_period: int = 48) -> DataFrame:
    for p in (short_period, long_period):
        if f"volume_sma_{p}" not in df.columns:
            df = sma(df, s, "volume", p)
    return df.withColumn("volume_trend", fdiv(f"volume_sma_{short_period}", f"volume_sma_{long_period}"))


def volume_weight(df: DataFrame, s: Series = S, period: int = 20, volume_weight_min: float = 0.5, volume_weight_max: float = 2.0) -> DataFrame:
    df = df.withColumn("volume_ma", s.mean("volume", period))
    return df.withColumn("volume_weight", clip(fdiv("volume", "volume_ma"), volume_weight_min, volume_weight_max))


def volume_spike(df: DataFrame, s: Series = S, period: int = 20, use_zscore: bool = False) -> DataFrame:
    mean = s.mean("volume", period)
    if use_zscore:
        return df.withColumn("volume_spike", fdiv(C("volume") - mean, s.std("volume", period) + 1e-10))
    return df.withColumn("volume_spike", fdiv("volume", mean))


def volume_regime(df: DataFrame, s: Series = S, lookback: int = 48) -> DataFrame:
    return df.withColumn("volume_regime", fdiv(s.mean("volume", lookback // 4), s.mean("volume", lookback)))


def volatility_weight(df: DataFrame, s: Series = S, period: int = 20, volatility_scaling_factor: float = 100.0, volatility_weight_min: float = 0.3, volatility_weight_max: float = 1.0) -> DataFrame:
    df = df.withColumn("__r", s.change("close"))
    df = df.withColumn("volatility", s.std("__r", period)).drop("__r")
    return df.withColumn("volatility_weight", clip(fdiv(F.lit(2.0), 1 + C("volatility") * volatility_scaling_factor), volatility_weight_min, volatility_weight_max))


def kline_imbalance(df: DataFrame, s: Series = S, window: int = 14) -> DataFrame:
    df = df.withColumn("__i", (1 - 2 * C("maker_ratio")) * C("no_of_trades"))
    return df.withColumn("imbalance", s.roll(F.sum, "__i", window, 1)).drop("__i")


def market_regime(df: DataFrame, s: Series = S, lookback: int = 48, short_sma: int = 20, long_sma: int = 50) -> DataFrame:
    """The averages' names don't follow their periods."""
    df = trend_strength(df, s, short_sma, long_sma)
    df = df.withColumns({"sma_20": s.mean("close", short_sma), "sma_50": s.mean("close", long_sma), "volume_sma": s.mean("volume", lookback), "__r": s.change("close")})
    df = df.withColumn("volatility_ratio", fdiv(s.std("__r", 12), s.std("__r", lookback))).drop("__r")
    df = volume_regime(df, s, lookback)
    votes = flag(C("trend_strength") > -0.001) + flag(C("volatility_ratio") < 2.0) + flag(C("volume_regime") > 0.7)
    return df.withColumn("market_favorable", votes / 3.0)


def entry_score_microstructure(
    df: DataFrame, s: Series = S, micro_momentum_period: int = 3, volume_spike_period: int = 20, spread_mean_period: int = 48,
    base: Sequence[float] = (0.25, 0.25, 0.25, 0.25), low_vol: Sequence[float] = (0.35, 0.15, 0.15, 0.35), high_vol: Sequence[float] = (0.15, 0.35, 0.35, 0.15),
    spike_bounds: Sequence[float] = (0.5, 1.5), spike_normalizer: float = 1.5, spread_bounds: Sequence[float] = (0.0, 2.0),
) -> DataFrame:
    """Weights: of position, momentum, volume and spread. Needs volatility_regime."""
    df = spread_percent(volume_spike(micro_momentum(position_in_candle(df, s), s, micro_momentum_period), s, volume_spike_period), s)
    terms = {
        "__t0": 1 - C("position_in_candle"),
        "__t1": flag(C("micro_momentum") > 0).cast("double"),
        "__t2": clip(C("volume_spike"), *spike_bounds) / spike_normalizer,
        "__t3": 1 - clip(fdiv("spread_percent", s.mean("spread_percent", spread_mean_period)), *spread_bounds),
    }
    df = df.withColumns(terms)
    total = lambda weights: sum((C(t) * w for t, w in zip(list(terms)[1:], weights[1:], strict=True)), C("__t0") * weights[0])
    score = F.when(C("volatility_regime") == "low", total(low_vol)).when(C("volatility_regime") == "high", total(high_vol)).otherwise(total(base))
    return df.withColumn("entry_score", score).drop(*terms)


def ichimoku_cloud(df: DataFrame, s: Series = S, tenkan_period: int = 9, kijun_period: int = 26, senkou_b_period: int = 52, displacement: int = 26, causal: bool = False) -> DataFrame:
    """By default senkou_a and senkou_b look `displacement` rows ahead; causal: they look back."""
    middle = lambda n: (s.roll(F.max, "high", n) + s.roll(F.min, "low", n)) / 2
    df = df.withColumns({"tenkan": middle(tenkan_period), "kijun": middle(kijun_period), "__b": middle(senkou_b_period)})
    df = df.withColumn("__a", (C("tenkan") + C("kijun")) / 2)
    shift = displacement if causal else -displacement
    return df.withColumns({"senkou_a": s.lag("__a", shift), "senkou_b": s.lag("__b", shift), "chikou": s.lag("close", displacement)}).drop("__a", "__b")


def sma_crossover(df: DataFrame, s: Series = S, short_window: int = 10, long_window: int = 30, crossover_bull: int = 2, crossover_bear: int = -2) -> DataFrame:
    short, long = s.mean("close", short_window), s.mean("close", long_window)
    df = df.withColumn("__side", flag(short > long) - flag(short < long))
    df = df.withColumn("crossover", C("__side") - s.lag("__side")).drop("__side")
    return df.withColumn("signal", F.when(C("crossover") == crossover_bull, 1).when(C("crossover") == crossover_bear, -1).otherwise(0))


def vwap(df: DataFrame, s: Series = S, price_col: str = "close", volume_col: str = "volume") -> DataFrame:
    """Cumulative within each calendar day."""
    day = Window.partitionBy(*s.keys, F.to_date("datetime")).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("vwap", fdiv(F.sum(C(price_col) * C(volume_col)).over(day), F.sum(volume_col).over(day)))


def ema_alignment(df: DataFrame, s: Series = S, ema_span: int = 21, power: float = 2.0) -> DataFrame:
    df = s.with_ewm(df, {"ema": ("close", 2.0 / (ema_span + 1))})
    return df.withColumn("ema_alignment", F.pow(clip(1 - fdiv(F.abs(C("close") - C("ema")), "ema"), 0, 1), F.lit(power)))


def breakout_features(df: DataFrame, s: Series = S, long_col: str = "breakout_long", short_col: str = "breakout_short", lookback: int = 12, horizon: int = 12, target: str = "breakout_pct") -> DataFrame:
    """Lagged break-outs, their rolling statistics and rates of change; rows with a null among these are dropped."""
    sides = {"long": long_col, "short": short_col}
    lags = range(horizon, horizon + lookback)
    df = df.withColumns({f"{side}_t-{k}": s.lag(c, k) for side, c in sides.items() for k in lags})
    added = [f"{side}_t-{k}" for side in sides for k in lags]
    stats, suffix = {}, f"_{horizon}_1"
    for side in sides:
        newest, before = F.col(f"`{side}_t-{horizon}`"), F.col(f"`{side}_t-{horizon + 1}`")
        stats |= {f"{side}_roll_mean": s.mean(newest, lookback), f"{side}_roll_std": s.std(newest, lookback)}
        stats[f"roc_{side}{suffix}"] = F.when(before != 0, fdiv(newest - before, before) * 100).otherwise(0.0)
    df = df.withColumns(stats)
    for c in [*added, *stats, target]:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


# targets


def forward_breakout_target(df: DataFrame, s: Series = S, forward_periods: int = 24, threshold: float = 0.02, shift: int = -1) -> DataFrame:
    """Then shifted: with -1 the label of a row describes the next row's future."""
    df = df.withColumn("forward_breakout", flag(fdiv(s.lag("close", -forward_periods) - C("close"), "close") >= threshold))
    return df.withColumn("forward_breakout", s.lag("forward_breakout", shift)) if shift else df


def ema_breakout(df: DataFrame, s: Series = S, target_col: str = "close", ema_span: int = 30, breakout_delta: float = 0.2, breakout_horizon: int = 3) -> DataFrame:
    later = s.lag(target_col, -breakout_horizon)
    df = s.with_ewm(df, {"__ema": (target_col, 2.0 / (ema_span + 1))})
    return drop_null_rows(df.withColumn("breakout_ema", flag(later > F.col("__ema") * (1 + breakout_delta))).drop("__ema"), ["breakout_ema"])


# regimes


def _regime(df: DataFrame, name: str, up, down) -> DataFrame:
    """Null conditions (warm-up) mean Flat."""
    return df.withColumn(name, F.when(up, "Up").when(down, "Down").otherwise("Flat"))


def ma_slope_regime(df: DataFrame, s: Series = S, period: int = 24, threshold: float = 0.0, normalize_by_std: bool = True) -> DataFrame:
    df = df.withColumn("__m", s.mean("close", period))
    slope = (C("__m") - s.lag("__m", period)) / period
    if normalize_by_std:
        slope = fdiv(slope, s.std("close", period) + 1e-12)
    return _regime(df.withColumn("__s", slope), "regime_ma_slope", C("__s") > threshold, C("__s") < -threshold).drop("__m", "__s")


def price_vs_band_regime(df: DataFrame, s: Series = S, period: int = 24, band: str = "std", k: float = 0.75) -> DataFrame:
    df = df.withColumn("__m", s.mean("close", period))
    width = s.std(C("close") - C("__m"), period) if band == "dev_std" else s.std("close", period)
    df = df.withColumn("__w", width * k)
    return _regime(df, "regime_price_band", C("close") > C("__m") + C("__w"), C("close") < C("__m") - C("__w")).drop("__m", "__w")


def breakout_percentile_regime(df: DataFrame, s: Series = S, period: int = 24, p_hi: float = 0.85, p_lo: float = 0.15) -> DataFrame:
    df = price_range_position(df, s, period)
    return _regime(df, "regime_breakout_pct", C("price_range_position") >= p_hi, C("price_range_position") <= p_lo)


def window_return_regime(df: DataFrame, s: Series = S, period: int = 24, r_hi: float = 0.0, r_lo: float = 0.0) -> DataFrame:
    df = df.withColumn(f"ret_{period}", s.change("close", period))
    return _regime(df, "regime_window_return", C(f"ret_{period}") >= r_hi, C(f"ret_{period}") <= r_lo)


def hh_hl_structure_regime(df: DataFrame, s: Series = S, window: int = 24, score_threshold: int = 4) -> DataFrame:
    high, low = s.lag("high"), s.lag("low")
    df = df.withColumn("__p", flag(C("high") > high) + flag(C("low") > low) - flag(C("high") < high) - flag(C("low") < low))
    df = df.withColumn("__s", s.roll(F.sum, "__p", window))
    return _regime(df, "regime_hh_hl", C("__s") >= score_threshold, C("__s") <= -score_threshold).drop("__p", "__s")
