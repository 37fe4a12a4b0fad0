"""The queries over market data and their SQL twins.

Doubles are rounded to six places on both sides; NaN and infinities become null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, drop_null_rows, finite, q_nearest
from ridgeline.operators import evaluation as ev
from ridgeline.operators import experiment as ex
from ridgeline.operators import features as ft
from ridgeline.operators import flux, long_series, pools, prep, spans, specs, sweep, time_joins
from ridgeline.operators.graph import FeatureGraph
from ridgeline.operators import indicators as ind
from ridgeline.operators.bars import compute_bars
from ridgeline.operators.klines import SUMMARY, klines, sessions, sliding
from ridgeline.plans import market_sql as q
from ridgeline.plans import surface
from ridgeline.sources import trades as tr

C = F.col
KLINE = ("open", "high", "low", "close", "mean", "std", "median", "iqr", "volume", "maker_ratio", "no_of_trades", "open_liquidity", "high_liquidity", "low_liquidity", "close_liquidity", "liquidity_sum", "maker_volume", "maker_liquidity")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.from_events(read(spark, sf_dir, "events"), F.concat(F.lit("u"), (C("user_id") % 4).cast("string")))


def hourly(spark: SparkSession, sf_dir: str, size: int = 3600, quantiles: str = "none") -> DataFrame:
    out = klines(trades(spark, sf_dir), size, quantiles=quantiles)
    return out.withColumn("datetime", C("datetime").cast("timestamp_ntz"))


def show(df: DataFrame, numbers: list[str], keys: tuple[str, ...] = ("series", "datetime"), others: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    return df.select(*keys, *others, *(F.round(finite(C(f"`{c}`").cast("double")), digits).alias(c) for c in numbers))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades to hourly klines, four features, split, train-only cut-off, label, rows without nulls."""
    s = Series(("series", "split"))
    df = prep.split_sequential(klines(tr.from_events(read(spark, sf_dir, "events")), quantiles="none").withColumn("datetime", C("datetime").cast("timestamp_ntz")))
    df = ft.kline_imbalance(ft.vwap(ind.atr(ind.roc(df, s, period=4), s), s), s)
    df = prep.target_quantile_flag(df, "roc_4", 0.3, -1)
    return drop_null_rows(df.select("series", "split", "datetime", "close", "roc_4", "atr_14", "vwap", "imbalance", "quantile_flag"))


def _over_klines(f: Callable[..., DataFrame], numbers: list[str], others: tuple[str, ...] = (), **params) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(f(_external(hourly(spark, sf_dir)), **params), numbers, others=others)

    return run


def _external(df: DataFrame) -> DataFrame:
    """Columns that some features expect from outside, made from the klines' own."""
    hour = F.hour("datetime")
    return df.withColumns({
        "volatility_regime": F.when(hour % 3 == 0, "low").when(hour % 3 == 1, "high").otherwise("normal"),
        "rolling_volatility": C("std") / C("mean"),
        "capturable_breakout": (C("high") - C("open")) / C("open"),
        "max_drawdown": (C("low") - C("open")) / C("open"),
        "exit_reason": F.element_at(F.array(*map(F.lit, ("target_hit", "trailing_stop", "stop_loss", "timeout"))), hour % 4 + 1),
        "exit_net_return": (C("close") - C("open")) / C("open"),
        "breakout_long": (C("high") - C("open")) / C("open"),
        "breakout_short": (C("open") - C("low")) / C("open"),
        "breakout_pct": (C("close") - C("open")) / C("open"),
    })


def _chain(*fs: Callable) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for f in fs:
            df = f(df)
        return df

    return run


#: name -> (operator on klines, numeric result columns, other result columns)
OVER_KLINES: dict[str, tuple] = {
    "ind_atr": (ind.atr, ["atr_14"]), "ind_body_pct": (ind.body_pct, ["body_pct"]), "ind_bollinger_bands": (ind.bollinger_bands, ["bb_middle", "bb_upper", "bb_lower"]),
    "ind_bollinger_position": (_chain(ind.bollinger_bands, ind.bollinger_position), ["bollinger_position"]), "ind_cci": (ind.cci, ["cci"]),
    "ind_macd": (ind.macd, ["macd_12_26", "macd_signal_9", "macd_hist"]), "ind_ppo": (ind.ppo, ["ppo_12_26", "ppo_signal_9", "ppo_hist"]),
    "ind_price_change_pct": (ind.price_change_pct, ["price_change_pct_1"]), "ind_returns": (ind.returns, ["returns"]), "ind_roc": (ind.roc, ["roc_12"]),
    "ind_rolling_volatility": (ind.rolling_volatility, ["close_volatility_12"]), "ind_rsi_sma": (ind.rsi_sma, ["rsi_sma_14"]), "ind_sma": (ind.sma, ["close_sma_20"]),
    "ind_sma_deviation_std": (ind.sma_deviation_std, ["sma30_dev_std"]), "ind_stochastic": (ind.stochastic_oscillator, ["stoch_k", "stoch_d"]),
    "ind_wilder_rsi": (ind.wilder_rsi, ["wilder_rsi_14"]), "ind_window_return": (ind.window_return, ["ret_24"]),
    "feat_close_position": (ft.close_position, ["close_position"]), "feat_position_in_candle": (ft.position_in_candle, ["position_in_candle"]), "feat_position_in_range": (ft.position_in_range, ["position_in_range"]),
    "feat_close_to_extremes": (ft.close_to_extremes, ["close_to_high", "close_to_low"]), "feat_range_pct": (ft.range_pct, ["range_pct"]), "feat_spread": (ft.spread, ["spread"]), "feat_spread_percent": (ft.spread_percent, ["spread_percent"]),
    "feat_dynamic_stop_loss": (_chain(ft.atr_percent_sma, ft.volatility_measure, ft.regime_multiplier, lambda d: ft.dynamic_stop_loss(d, base_stop_loss=0.3)), ["dynamic_stop_loss"]),
    "feat_dynamic_target": (_chain(ft.atr_percent_sma, ft.volatility_measure, ft.regime_multiplier, lambda d: ft.dynamic_target(d, base_min_breakout=0.3)), ["dynamic_target"]),
    "feat_exit_quality": (ft.exit_quality, ["exit_quality"]), "feat_regime_multiplier": (ft.regime_multiplier, ["regime_multiplier"]), "feat_risk_reward_ratio": (ft.risk_reward_ratio, ["risk_reward_ratio"]),
    "feat_volatility_measure": (_chain(ft.atr_percent_sma, ft.volatility_measure), ["volatility_measure"]), "feat_volatility_1h": (ft.volatility_1h, ["volatility_1h"]),
    "feat_feature_aliases": (_chain(ft.momentum_confirmation, lambda d: d.withColumns({"dynamic_target": ft.S.lag("close"), "entry_score": ft.S.lag("open", 2)}), lambda d: ft.feature_aliases(d, volatility_regime_enabled=False)), ["dynamic_target_feature", "entry_score_feature", "momentum_score_feature"]),
    "feat_time_features": (ft.time_features, ["hour", "minute", "weekday"]), "feat_quantile_flag": (lambda d: ft.quantile_flag(d, col="close", cutoff=250.0), ["quantile_flag"]),
    "feat_gap_high": (ft.gap_high, ["gap_high"]), "feat_log_returns": (ft.log_returns, ["log_returns"]), "feat_lag_range_cols": (lambda d: ft.lag_range_cols(d, cols=["close", "volume"], start=1, end=3), ["close_lag_1", "close_lag_2", "close_lag_3", "volume_lag_1", "volume_lag_2", "volume_lag_3"]),
    "feat_lag_column": (lambda d: ft.lag_columns(ft.lag_column(d, col="high", lag=4), cols=["low"], lag=2), ["high_lag_4", "low_lag_2"]), "feat_returns_lags": (lambda d: ft.returns_lags(d, max_lag=3), ["returns", "returns_lag_1", "returns_lag_2", "returns_lag_3"]),
    "feat_micro_momentum": (ft.micro_momentum, ["micro_momentum"]), "feat_momentum_periods": (ft.momentum_periods, ["momentum_12", "momentum_24", "momentum_48"]), "feat_momentum_confirmation": (ft.momentum_confirmation, ["momentum_score"]),
    "feat_momentum_weight": (ft.momentum_weight, ["momentum_weight"]), "feat_distance_from_high": (ft.distance_from_high, ["distance_from_high"]), "feat_distance_from_low": (ft.distance_from_low, ["distance_from_low"]),
    "feat_price_range_position": (ft.price_range_position, ["price_range_position"]), "feat_atr_sma": (ft.atr_sma, ["atr_sma"]), "feat_atr_percent_sma": (ft.atr_percent_sma, ["atr_percent_sma"]),
    "feat_trend_strength": (ft.trend_strength, ["trend_strength"]), "feat_sma_ratios": (ft.sma_ratios, ["sma_5_ratio", "sma_10_ratio", "sma_20_ratio", "sma_50_ratio", "close_sma_5"]), "feat_volume_ratio": (ft.volume_ratio, ["volume_ratio"]),
    "feat_volume_trend": (ft.volume_trend, ["volume_trend"]), "feat_volume_weight": (ft.volume_weight, ["volume_weight"]), "feat_volume_spike": (ft.volume_spike, ["volume_spike"]),
    "feat_volume_spike_z": (lambda d: ft.volume_spike(d, use_zscore=True), ["volume_spike"]), "feat_volume_regime": (ft.volume_regime, ["volume_regime"]), "feat_volatility_weight": (ft.volatility_weight, ["volatility", "volatility_weight"]),
    "feat_kline_imbalance": (ft.kline_imbalance, ["imbalance"]), "feat_market_regime": (ft.market_regime, ["sma_20", "sma_50", "volume_sma", "trend_strength", "volatility_ratio", "volume_regime", "market_favorable"]),
    "feat_entry_score": (ft.entry_score_microstructure, ["entry_score"]), "feat_ichimoku": (ft.ichimoku_cloud, ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"]), "feat_sma_crossover": (ft.sma_crossover, ["crossover", "signal"]),
    "feat_vwap": (ft.vwap, ["vwap"]), "feat_ema_alignment": (ft.ema_alignment, ["ema", "ema_alignment"]),
    "feat_breakout_features": (ft.breakout_features, ["long_t-12", "short_t-23", "long_roll_mean", "long_roll_std", "short_roll_mean", "short_roll_std", "roc_long_12_1", "roc_short_12_1"]),
    "target_forward_breakout": (ft.forward_breakout_target, ["forward_breakout"]), "target_ema_breakout": (ft.ema_breakout, ["breakout_ema"]),
    "regime_ma_slope": (ft.ma_slope_regime, [], ("regime_ma_slope",)), "regime_price_band": (ft.price_vs_band_regime, [], ("regime_price_band",)), "regime_price_band_dev": (lambda d: ft.price_vs_band_regime(d, band="dev_std"), [], ("regime_price_band",)),
    "regime_breakout_pct": (ft.breakout_percentile_regime, ["price_range_position"], ("regime_breakout_pct",)), "regime_window_return": (ft.window_return_regime, ["ret_24"], ("regime_window_return",)), "regime_hh_hl": (ft.hh_hl_structure_regime, [], ("regime_hh_hl",)),
}


# sources


def trades_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.select_trades(trades(spark, sf_dir), month_year=(1, 2024)).select("trade_id", "datetime", "price", "quantity")


def trades_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.select_trades(trades(spark, sf_dir), n_rows=100).select("trade_id", "price", "quantity")


def trades_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.select_trades(trades(spark, sf_dir), n_random=100).select("trade_id", "price", "quantity")


def ts_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(C("trade_id") % 2 == 0, C("timestamp") * 1000).otherwise(C("timestamp"))
    return tr.normalise(trades(spark, sf_dir).select("trade_id", mixed.alias("timestamp"))).select("trade_id", "timestamp", "datetime")


# klines and bars


def _klines(size: int, by: Callable | None = None, **limits) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = trades(spark, sf_dir) if by is None else by(spark, sf_dir)
        out = klines(own, size, **limits)
        return show(out.withColumn("datetime", C("datetime").cast("timestamp_ntz")), list(KLINE))

    return run


BAR_NUMBERS = ["open", "high", "low", "close", "volume", "no_of_trades", "liquidity_sum", "maker_ratio", "maker_volume", "maker_liquidity", "mean", "bar_count", "base_interval"]


def _bars(kind: str, threshold: float) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = compute_bars(hourly(spark, sf_dir), kind, threshold)
        return show(bars, BAR_NUMBERS)

    return run


def cfr_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at the small scales few hours have two bins of a user group: all trades are one series
    out = flux.conserved_flux(tr.from_events(read(spark, sf_dir, "events")))
    return show(out, ["open", "high", "low", "close", "volume", "vwap", "flux_rel_std_mean", "flux_rel_std_var", "entropy_mean", "entropy_var", "dflux_rms", "dentropy_rms"])


# spans


def _spans(f: Callable, name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = prep.row_index(hourly(spark, sf_dir)).select("series", "datetime", "i", "close")
        lines = rows.where("i % 7 = 0").select("series", (C("i") - 3).alias("start_idx"), (C("i") + F.floor(C("close")).cast("long") % 12).alias("end_idx"))
        return show(f(rows, lines), [name], ("series", "i"))

    return run


# preparation


def _split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_sequential(hourly(spark, sf_dir))


def split_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_frame(spark, sf_dir).select("series", "datetime", "split")


def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_random(hourly(spark, sf_dir), seed=7).select("series", "datetime", "split")


def random_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.row_index(hourly(spark, sf_dir))
    return show(prep.random_slice(rows, 100, 500, 0.1, 0.9, seed=3), ["close"], ("series", "i"))


def missing_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = hourly(spark, sf_dir)
    return prep.missing_datetimes(before, drop_null_rows(ind.roc(before, period=5), ["roc_5"]))


def target_quantile_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.roc(_split_frame(spark, sf_dir), Series(("series", "split")), period=4)
    return show(prep.target_quantile_flag(df, "roc_4", 0.3, -1), ["quantile_flag"], others=("split",))


def _on_numbers(f: Callable, columns: tuple[str, ...] = ("close", "volume", "std")) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(f(hourly(spark, sf_dir).select("series", "datetime", *columns)), list(columns))

    return run


SCALED = ["close", "volume", "maker_ratio", "std"]


def scaler_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split_frame(spark, sf_dir)
    scaler = prep.Scaler(SCALED)
    return show(scaler.transform(df, scaler.fit(df)), SCALED)


def scaler_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split_frame(spark, sf_dir)
    scaler = prep.Scaler(SCALED)
    fitted = scaler.fit(df)
    return show(scaler.inverse(scaler.transform(df, fitted), fitted), SCALED)


def scaler_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _split_frame(spark, sf_dir).withColumn("wilder_rsi", C("maker_ratio") * 100).withColumn("atr_14", C("std"))
    columns = ["close", "volume", "wilder_rsi", "atr_14"]
    scaler = prep.Scaler(columns, prep.exact_rules(prep.LOGREG_NAMES))
    return show(scaler.transform(df, scaler.fit(df)), columns)


# evaluation: a fixed rule stands for the model


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series (as round): close above its mean of 5 predicts that the next close is higher."""
    df = ind.sma(hourly(spark, sf_dir), column="close", period=5)
    up = ft.S.lag("close", -1)
    df = df.withColumns({"actual": (up > C("close")).cast("int"), "prediction": (C("close") < C("close_sma_5")).cast("int"), "proba": F.round(C("close_sma_5") / (C("close") + C("close_sma_5")), 2), "target": up, "price_change": C("close") - C("open")})
    return drop_null_rows(df, ["actual", "prediction"]).withColumnRenamed("series", "round_id")


def _eval(f: Callable, numbers: list[str]) -> Callable:
    return lambda spark, sf_dir: show(f(predictions(spark, sf_dir)), numbers, ("round_id",))


CONFUSION = ["pred_pos_rate_pct", "actual_pos_rate_pct", "precision_pct", "recall_pct", "tp_x_mean", "fp_x_mean", "tp_x_median", "fp_x_median", "pred_pos_count", "pred_pos_x_mean", "pred_pos_x_median", "tp_count", "fp_count", "tp_fp_cohen_d", "tp_fp_ks", "n_kept"]
SNAPSHOT = ["trade_win_rate_pct", "trade_expectancy_pct", "max_drawdown_pct", "total_return_gross_pct", "total_return_net_pct", "trade_return_mean_win_pct", "trade_return_mean_loss_pct", "bars_total", "sharpe_per_bar", "bars_in_market_pct", "trades_count", "cost_round_trip_bps"]


def _classes(df: DataFrame) -> DataFrame:
    kind = lambda c: F.pmod(F.floor(c), F.lit(3)).cast("int")
    return df.withColumns({"actual": kind(C("target")), "prediction": kind(C("close"))})


def _many_models(df: DataFrame) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(i).alias("model"), (C("close") * (1 + 0.01 * i) + i * C("maker_ratio")).alias("prediction")) for i in range(3)))).alias("x")
    long = df.where("target IS NOT NULL").withColumn("split", F.when(F.hour("datetime") % 2 == 0, "val").otherwise("test"))
    return long.select("round_id", "datetime", "split", C("target").alias("actual"), models).select("round_id", "datetime", "split", "actual", "x.*")


def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.confidence_filter(_many_models(predictions(spark, sf_dir)), ["round_id", "datetime"])
    return show(out, ["prediction", "uncertainty", "confidence_threshold", "actual_value", "confidence_score"], ("round_id", "datetime"), ("is_confident",))


def aggregate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    out = [pools.aggregate_predictions(df, how).withColumn("how", F.lit(how)) for how in ("mean", "median")]
    out.append(pools.aggregate_predictions(df.withColumn("rank", F.substring("round_id", 2, 1).cast("int")), "majority", order="rank").withColumn("how", F.lit("majority")))
    return show(out[0].unionByName(out[1]).unionByName(out[2]), ["prediction"], ("how", "datetime"))


def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(pools.iqr_filter(hourly(spark, sf_dir), ["volume", "std"], 0.5), ["volume", "std"])


# models and composites


def _flag(p: dict) -> str:
    return f"flag_{p['roc_period']}_{round(p['q'] * 100)}"


def _prepared(spark: SparkSession, sf_dir: str, rounds: list[dict]) -> DataFrame:
    s = Series(("series", "split"))
    df = _split_frame(spark, sf_dir)
    df = sweep.compute_features(df, [(ind.roc, {"period": "roc_period"}), (ind.atr, {"period": 14}), (ft.kline_imbalance, {}), (ft.volume_ratio, {})], rounds, s)
    df = prep.target_quantile_flags(df, {_flag(p): (f"roc_{p['roc_period']}", p["q"]) for p in rounds}, -1)
    return df.withColumn("next_close", s.lag("close", -1))


def _rounds(n: int) -> list[dict]:
    return list(sweep.ParamSpace({"roc_period": [1, 4, 8, 12], "q": [0.3, 0.4], "c": [0.1, 1.0, 10.0], "class_weight": [0.5, 1.0]}, n, seed=11))


FEATURES = lambda p: [f"roc_{p['roc_period']}", "atr_14", "imbalance", "volume_ratio"]


def sweep_predictions(spark: SparkSession, sf_dir: str, n: int = 8, model: str = "logreg") -> DataFrame:
    rounds = _rounds(n)
    target = (lambda p: "next_close") if model == "boosted" else _flag
    return sweep.run_sweep(_prepared(spark, sf_dir, rounds), rounds, FEATURES, target, model)


def _by_round(df: DataFrame) -> DataFrame:
    """A table of one row per listed round, held by the driver, so that later steps don't train again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def sweep_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sweep_predictions(spark, sf_dir)
    return sweep.experiment_log(ev.binary_metrics(got), _rounds(8))


def sweep_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary_metrics(sweep_predictions(spark, sf_dir, 4, "random"))


def sweep_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.experiment_log(ev.continuous_metrics(sweep_predictions(spark, sf_dir, 4, "boosted")), _rounds(4))


def sweep_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ev.prediction_performance(sweep_predictions(spark, sf_dir), hourly(spark, sf_dir))
    return ev.backtest_snapshot(got, keys=("round_id", "series"))


def parameter_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _by_round(sweep_logreg(spark, sf_dir))
    return ev.parameter_correlation(log, "auc", ["roc_period", "q", "c"], heads=(0.99, 0.75, 0.5, 0.25, 0.01), n_boot=300)


def pools_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _by_round(ev.binary_metrics(sweep_predictions(spark, sf_dir, 12)))
    return pools.offline_pools(got, ["recall", "precision", "accuracy"], 2, 2)


def pools_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sweep_predictions(spark, sf_dir, 12)
    chosen = pools.offline_pools(_by_round(ev.binary_metrics(got)), ["recall", "precision", "accuracy"], 2, 2)
    return pools.online_pools(got, chosen, "majority", ("series", "datetime"))


def sequential_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sequential_backtest(predictions(spark, sf_dir))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).withColumn("split", F.when(F.hour("datetime") % 2 == 0, "val").otherwise("test"))
    return show(sweep.calibrate(df), ["calibrated"], ("round_id", "datetime"))


# experiments by manifest


def _bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("series", "datetime", "open", "high", "low", "close", "volume", "maker_ratio", "no_of_trades")


def manifest_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest makes of the bars: split, feature, fitted target, scaling."""
    m = ex.Manifest().add_indicator(ind.roc, period="p").with_target("flag").add_fitted_transform(ex.flag_above).fit_param("_cut", ex.quantile_cutoff, col="roc_{p}", q="q").with_params(target_column="target_column", col="roc_{p}", cutoff="_cut")
    m = m.add_transform(ex.shifted, column="target_column", shift="shift").done().set_scaler(prep.exact_rules(prep.LOGREG_NAMES))
    found = m.prepare(hourly(spark, sf_dir).select("series", "datetime", "close", "volume"), {"p": 4, "q": 0.3, "shift": -1})
    return show(found.rows, ["close", "volume", "roc_4", "flag"], others=("split",))


def _experiment(name: str, params: dict, metrics: Callable = ev.binary_metrics, n: int = 2) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = specs.SPECS[name]
        return ex.Experiment(spec, _bars_of(spark, sf_dir)).run(n, seed=3, params={**spec.params(), **params}).log(metrics).drop("seconds")

    return run


def manifest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = specs.SPECS["random"]
    return ex.Experiment(spec, _bars_of(spark, sf_dir)).run(2, seed=3).confusion("price_change")


def manifest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared rows of eight rounds from one graph: period, quantile and shift differ."""
    m = ex.Manifest().add_indicator(ind.roc, period="p").with_target("flag").add_fitted_transform(ex.flag_above).fit_param("_cut", ex.quantile_cutoff, col="roc_{p}", q="q").with_params(target_column="target_column", col="roc_{p}", cutoff="_cut")
    m = m.add_transform(ex.shifted, column="target_column", shift="shift").done()
    rounds = [{"p": p, "q": k, "shift": shift} for p in (1, 4) for k in (0.3, 0.4) for shift in (-1, -2)]
    rows = FeatureGraph(m, hourly(spark, sf_dir).select("series", "datetime", "close", "volume"), rounds).packed
    return show(rows.withColumns({c: F.get("x", i) for i, c in enumerate(("close", "volume", "roc"))}).withColumnRenamed("y", "flag"), ["close", "volume", "roc", "flag"], others=("round_id", "split"))


# one series of all trades, in segments

TICKS, TICK_ROWS = Series(("series",), ("datetime", "trade_id")), 4096


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.from_events(read(spark, sf_dir, "events")).select("series", "datetime", "trade_id", "price", "quantity")


def _tick_windows(df: DataFrame, s: Series) -> DataFrame:
    mean = s.mean("price", 20)
    df = df.withColumns({"mean_20": mean, "std_20": s.std("price", 20), "change_12": s.change("price", 12), "top_50": s.roll(F.max, "price", 50), "ahead_5": s.lag("price", -5)})
    return df.withColumn("dev_std", s.std("mean_20", 10))


def long_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = long_series.rolling(_ticks(spark, sf_dir), _tick_windows, TICKS, look_back=50, look_ahead=5, segment_rows=TICK_ROWS)
    return show(out, ["mean_20", "std_20", "change_12", "top_50", "ahead_5", "dev_std"], keys=("datetime", "trade_id"))


def long_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = long_series.rolling(_ticks(spark, sf_dir), lambda d, s: d.withColumn("gross", 1 + s.change("price")), TICKS, look_back=1, segment_rows=TICK_ROWS)
    df = df.withColumn("large", F.when(C("quantity") > 5, C("price")))
    out = long_series.running(df, {"total": ("sum", "quantity"), "top": ("max", "price"), "n_large": ("count", "large"), "equity": ("product", "gross"), "last_large": ("last", "large")}, TICKS, TICK_ROWS)
    return show(out, ["total", "top", "n_large", "equity", "last_large"], keys=("datetime", "trade_id"), digits=4)


def long_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = long_series.ewm(_ticks(spark, sf_dir), {"ewm_14": ("price", 1 / 14), "ewm_3": ("quantity", 1 / 3)}, TICKS, TICK_ROWS)
    return show(out, ["ewm_14", "ewm_3"], keys=("datetime", "trade_id"))


# plain SQL


def sql_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_volume in SQL."""
    surface.register(spark)
    out = spark.sql("SELECT * FROM activity_bars(TABLE(SELECT * FROM {klines}) PARTITION BY series ORDER BY (datetime), 2000D, 'volume')", klines=hourly(spark, sf_dir))
    return show(out, BAR_NUMBERS)


def sql_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequential_backtest in SQL."""
    surface.register(spark)
    return spark.sql("SELECT * FROM sequential_backtest(TABLE(SELECT * FROM {predictions}) PARTITION BY round_id ORDER BY (datetime), 30000D, 0.001D)", predictions=predictions(spark, sf_dir))


# overlapping windows and sessions of trades


def _windows(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(trades(spark, sf_dir)).withColumns({c: C(c).cast("timestamp_ntz") for c in ("datetime", "end")})
        return show(out, list(SUMMARY), others=("end",))

    return run


# joins by time


def _calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars that close above their mean: of each series some hours are missing."""
    return hourly(spark, sf_dir).where("close > mean").select("series", C("datetime").alias("bar_time"), "close")


def _asof(direction: str, tolerance: int | None, exact: bool) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = _calm_bars(spark, sf_dir).withColumn("datetime", C("bar_time"))
        rows = trades(spark, sf_dir).select("series", "datetime", "trade_id", "price")
        out = time_joins.asof_join(rows, bars, direction=direction, tolerance=tolerance, exact=exact, columns=["bar_time", "close"], segment_rows=TICK_ROWS)
        return show(out, ["price", "close"], keys=("trade_id", "bar_time"))

    return run


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of each bar's next hours, as many as its last digit says, summed up by bar."""
    spans = hourly(spark, sf_dir).select("series", C("datetime").alias("start"), (C("datetime") + F.make_dt_interval(hours=(C("no_of_trades") % 10).cast("int"))).alias("end"))
    met = time_joins.interval_join(trades(spark, sf_dir), spans)
    return show(met.groupBy("series", "start").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.max("price").alias("top")), ["n", "quantity", "top"], keys=("series", "start"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    by_type = lambda spark, sf_dir: tr.from_events(read(spark, sf_dir, "events"), C("event_type"))
    out = {name: _over_klines(entry[0], entry[1], *entry[2:]) for name, entry in OVER_KLINES.items()}
    out |= {
        "trades_month": trades_month, "trades_latest": trades_latest, "trades_sample": trades_sample, "ts_normalise": ts_normalise, "klines_1h": _klines(3600), "klines_4h": _klines(14400), "klines_by_type": _klines(3600, by_type), "klines_first": _klines(3600, start="2024-01-05", n_rows=50), "klines_newest": _klines(7200, n_rows=50, latest=True),
        "bars_volume": _bars("volume", 2000), "bars_trade": _bars("trade", 40), "bars_liquidity": _bars("liquidity", 500000), "cfr_1h": cfr_1h,
        "span_active_lines": _spans(spans.active_lines, "active_lines"), "span_active_quantile_count": _spans(spans.active_quantile_count, "active_quantile_count"),
        "span_since_big_move": _spans(spans.hours_since_big_move, "hours_since_big_move"), "span_since_quantile_line": _spans(spans.hours_since_quantile_line, "hours_since_quantile_line"), "span_density": _spans(spans.quantile_line_density, "quantile_line_density_48h"),
        "split_sequential": split_sequential, "split_random": split_random, "random_slice": random_slice, "missing_datetimes": missing_datetimes, "target_quantile_flag": target_quantile_flag,
        "shift_column": _on_numbers(lambda d: prep.shift_column(d, "close", 2)), "zscore": _on_numbers(prep.zscore), "mad": _on_numbers(prep.mad), "winsorize": _on_numbers(prep.winsorize), "quantile_trim": _on_numbers(lambda d: prep.quantile_trim(d, low=0.05, high=0.95)),
        "scaler_linear": scaler_linear, "scaler_inverse": scaler_inverse, "scaler_logreg": scaler_logreg,
        "binary_metrics": _eval(ev.binary_metrics, ["recall", "precision", "fpr", "accuracy", "auc"]), "multiclass_metrics": _eval(lambda d: ev.multiclass_metrics(_classes(d.where("target IS NOT NULL"))), ["precision", "recall", "accuracy"]),
        "ovr_auc": _eval(lambda d: ev.ovr_auc(_classes(d.where("target IS NOT NULL")), "actual", {0: "open", 1: "close", 2: "volume"}), ["auc"]),
        "continuous_metrics": _eval(lambda d: ev.continuous_metrics(d.where("target IS NOT NULL"), "target", "close"), ["bias", "mae", "rmse", "r2", "mape"]), "balanced_metric": _eval(ev.balanced_metric, ["balanced"]),
        "threshold_sweep": _eval(ev.optimize_threshold, ["threshold", "balanced"]), "confusion_metrics": _eval(lambda d: ev.confusion_metrics(d, "price_change"), CONFUSION), "backtest_snapshot": _eval(ev.backtest_snapshot, SNAPSHOT),
        "rank_correlation": _eval(lambda d: ev.rank_correlation(d, "close", "volume"), ["correlation"]), "confidence_filter": confidence_filter, "aggregate_predictions": aggregate_predictions, "iqr_filter": iqr_filter,
        "sweep_logreg": sweep_logreg, "sweep_random": sweep_random, "sweep_boosted": sweep_boosted, "sweep_backtest": sweep_backtest, "parameter_correlation": parameter_correlation, "pools_offline": pools_offline, "pools_online": pools_online,
        "sequential_backtest": sequential_backtest, "calibrate": calibrated, "flagship": lambda spark, sf_dir: show(flagship(spark, sf_dir), ["close", "roc_4", "atr_14", "vwap", "imbalance", "quantile_flag"], others=("split",)),
        "threshold_f1": _eval(lambda d: ev.optimize_threshold(d, metric="f1"), ["threshold", "f1"]), "threshold_default": _eval(lambda d: ev.optimize_threshold(d.withColumn("proba", C("proba") / 10)), ["threshold", "balanced"]),
        "iqr_filter_constant": lambda spark, sf_dir: show(pools.iqr_filter(hourly(spark, sf_dir).withColumn("flat", (C("close") > 450).cast("int")), ["flat", "std"]), ["flat", "std"]),
        "manifest_prepared": manifest_prepared, "manifest_logreg": _experiment("logreg", {"roc_period": [1, 4, 12], "shift": [-1, -2]}), "manifest_random": _experiment("random", {}),
        "manifest_boosted": _experiment("boosted", {"n_estimators": [30], "learning_rate": [0.1]}, ev.continuous_metrics), "manifest_calibrated": _experiment("calibrated", {"forward_periods": [2, 4]}), "manifest_confusion": manifest_confusion,
        "manifest_graph": manifest_graph, "long_rolling": long_rolling, "long_running": long_running, "long_ewm": long_ewm,
        "asof_backward": _asof("backward", None, True), "asof_forward": _asof("forward", 6 * 3_600_000_000, False), "asof_nearest": _asof("nearest", None, True), "interval_join": interval_join,
        "sql_bars": sql_bars, "sql_backtest": sql_backtest, "windows_sliding": _windows(lambda d: sliding(d, 3600, 900)), "windows_session": _windows(lambda d: sessions(d, 1200)),
    }
    return out


def oracle_sql() -> dict[str, str]:
    return q.oracle_sql()
