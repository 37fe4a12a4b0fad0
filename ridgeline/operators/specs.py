"""Ready specs: the parameters of a search and the manifest of each."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from ridgeline.operators import experiment as ex
from ridgeline.operators import features as ft
from ridgeline.operators import indicators as ind
from ridgeline.operators import models, prep

C = F.col
#: Search spaces. Fixed values.
LOGREG = {
    "shift": [-1, -2, -3, -4, -5], "q": [0.35, 0.38, 0.41, 0.44, 0.47, 0.50, 0.53], "roc_period": [1, 4, 12, 24, 144], "penalty": ["l2"], "class_weight": [0.45, 0.55, 0.65, 0.75, 0.85],
    "C": [0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0], "max_iter": [30, 60, 90, 120, 180, 240], "solver": ["lbfgs", "newton-cg", "liblinear", "sag", "newton-cholesky"], "tol": [0.001, 0.01, 0.03, 0.1, 0.3],
}
RANDOM = {"random_weights": [0.4, 0.5, 0.6], "breakout_threshold": [0.05, 0.1, 0.2], "shift": [-1, -2, -3]}
CALIBRATED = {
    "forward_periods": [2, 4, 6, 8, 12, 24], "threshold_pct": [0.005, 0.0075, 0.01, 0.0125, 0.015, 0.02, 0.025, 0.03], "use_calibration": [True, False], "threshold_metric": ["balanced", "f1", "precision"],
    "rsi_period": [7, 14, 21], "bb_window": [10, 20, 30], "bb_std": [1.5, 2.0, 2.5],
}
BOOSTED = {
    "learning_rate": [0.01, 0.02, 0.03], "max_depth": [2, 3, 4], "n_estimators": [300, 500, 700], "min_child_weight": [5, 10, 20], "subsample": [0.5, 0.6, 0.7], "colsample_bytree": [0.5, 0.6, 0.7],
    "gamma": [0.1, 0.5, 1.0], "reg_alpha": [0.1, 0.5, 1.0], "reg_lambda": [1.0, 5.0, 10.0], "objective": ["reg:squarederror"], "booster": ["gbtree"], "early_stopping_rounds": [50],
}


def _logreg() -> ex.Manifest:
    return (
        ex.Manifest().set_split_config(8, 1, 2)
        .add_indicator(ind.roc, period="roc_period").add_indicator(ind.atr, period=14).add_indicator(ind.ppo).add_indicator(ind.wilder_rsi).add_feature(ft.vwap).add_feature(ft.kline_imbalance)
        .with_target("quantile_flag")
        .add_fitted_transform(ex.flag_above).fit_param("_quantile_cutoff", ex.quantile_cutoff, col="roc_{roc_period}", q="q").with_params(target_column="target_column", col="roc_{roc_period}", cutoff="_quantile_cutoff")
        .add_transform(ex.shifted, column="target_column", shift="shift").done()
        .set_scaler(prep.exact_rules(prep.LOGREG_NAMES)).with_model(models.logreg_binary)
    )


def _coin(df, s):
    """A target by chance: a bit of the hash of the row's place. The last row of each split has none."""
    return df.withColumn("outcome", F.when(s.lag("close", -1).isNotNull(), (F.xxhash64(*s.keys, *s.order) % 2 == 0).cast("int")))


def _random() -> ex.Manifest:
    return ex.Manifest().set_split_config(3, 1, 1).set_required_bar_columns(["datetime", "high", "low", "close", "volume", "maker_ratio", "no_of_trades"]).with_target("outcome").add_transform(_coin).done().with_model(models.random_binary)


def _flows(df, s):
    return df.withColumns({"dollar_volume": C("volume") * C("close"), "order_flow_imbalance": C("maker_ratio") - 0.5, "trade_intensity": C("no_of_trades") / C("no_of_trades_sma_20")})


def _next_return(df, s):
    return df.withColumn("next_return", (s.lag("close", -1) - C("close")) / C("close") * 100)


def _boosted() -> ex.Manifest:
    lagged = ["range_pct", "volume_sma_20", "volume_ratio", "dollar_volume", "maker_ratio_sma_10", "trade_intensity", "body_pct", "order_flow_imbalance", "stoch_k"]
    return (
        ex.Manifest().set_split_config(8, 1, 2)
        .add_indicator(ind.window_return, period=1).add_indicator(ind.window_return, period=5).add_indicator(ind.window_return, period=20).add_indicator(ind.rolling_volatility, column="ret_1", window=20)
        .add_indicator(ind.sma, column="volume", period=20).add_indicator(ind.sma, column="maker_ratio", period=10).add_indicator(ind.sma, column="no_of_trades", period=20).add_indicator(ind.stochastic_oscillator)
        .add_feature(ind.body_pct).add_feature(ft.range_pct).add_feature(ft.volume_ratio, period=20).add_feature(ft.sma_ratios, periods=[10, 50], price_col="close").add_feature(_flows).add_feature(ft.lag_columns, cols=lagged, lag=1)
        .with_target("next_return").add_transform(_next_return).done().with_model(models.boosted_regressor)
    )


def _calibrated() -> ex.Manifest:
    out = ex.Manifest().set_split_config(50, 20, 30).set_required_bar_columns(["datetime", "open", "high", "low", "close", "volume"])
    for period in (1, 4, 12, 24):
        out.add_indicator(ind.roc, period=period)
    for window in (4, 12, 24):
        out.add_indicator(ind.rolling_volatility, column="close", window=window)
    out.add_indicator(ind.wilder_rsi, period="rsi_period").add_indicator(ind.bollinger_bands, price_col="close", window="bb_window", num_std="bb_std").add_indicator(ind.bollinger_position)
    return out.with_target("forward_breakout").add_transform(ft.forward_breakout_target, forward_periods="forward_periods", threshold="threshold_pct", shift=-1).done().with_model(models.calibrated_binary)


#: Name -> spec with params() and manifest().
SPECS = {name: SimpleNamespace(params=lambda p=p: p, manifest=m) for name, p, m in (("logreg", LOGREG, _logreg), ("random", RANDOM, _random), ("boosted", BOOSTED, _boosted), ("calibrated", CALIBRATED, _calibrated))}
