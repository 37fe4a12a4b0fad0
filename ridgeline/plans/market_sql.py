"""DuckDB twins of the market queries."""

from __future__ import annotations

from ridgeline.plans.sql import TRADES, change, clip, ewm, klines, lag, mean, near, roll, rows, stages, std

K = klines()
EXT = f"""SELECT *, CASE hour(datetime) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'normal' END AS volatility_regime, std / mean AS rolling_volatility,
  (high - open) / open AS capturable_breakout, (low - open) / open AS max_drawdown, ['target_hit', 'trailing_stop', 'stop_loss', 'timeout'][hour(datetime) % 4 + 1] AS exit_reason,
  (close - open) / open AS exit_net_return, (high - open) / open AS breakout_long, (open - low) / open AS breakout_short, (close - open) / open AS breakout_pct FROM ({K})"""
KLINE = ["open", "high", "low", "close", "mean", "std", "median", "iqr", "volume", "maker_ratio", "no_of_trades", "open_liquidity", "high_liquidity", "low_liquidity", "close_liquidity", "liquidity_sum", "maker_volume", "maker_liquidity"]
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
GAIN = {"g": f"CASE WHEN close > {lag('close')} THEN close - {lag('close')} ELSE 0.0 END", "l": f"CASE WHEN close < {lag('close')} THEN {lag('close')} - close ELSE 0.0 END"}
A = lambda n: 2.0 / (n + 1)
ATRP = {"tr": TR}
REGIME_MULT = "CASE volatility_regime WHEN 'low' THEN 0.8 WHEN 'high' THEN 1.2 ELSE 1.0 END"


def _macd(line: str, expr: str) -> list[dict[str, str]]:
    return [{"f": ewm("close", A(12)), "s": ewm("close", A(26))}, {f"{line}_12_26": expr}, {f"{line}_signal_9": ewm(f"{line}_12_26", A(9))}, {f"{line}_hist": f"{line}_12_26 - {line}_signal_9"}]


def _score(w: tuple[float, ...]) -> str:
    return f"t0 * {w[0]} + t1 * {w[1]} + t2 * {w[2]} + t3 * {w[3]}"


def _updown(name: str, up: str, down: str) -> dict[str, str]:
    return {name: f"CASE WHEN {up} THEN 'Up' WHEN {down} THEN 'Down' ELSE 'Flat' END"}


_DYN = [ATRP, {"ap": f"{mean('tr', 14)} / close"}]
_vm = "(rolling_volatility + ap) / 2"
_sides = {"long": "breakout_long", "short": "breakout_short"}

#: name -> (steps, results); a result with = is shown as it is. Where a third part stands, it filters.
OVER_KLINES: dict[str, tuple] = {
    "ind_atr": ([ATRP, {"atr_14": ewm("tr", 1 / 14)}], ["atr_14"]),
    "ind_body_pct": ([{"body_pct": "(close - open) / open"}], ["body_pct"]),
    "ind_bollinger_bands": ([{"m": mean("close", 20), "s": std("close", 20)}, {"bb_middle": "m", "bb_upper": "m + 2 * s", "bb_lower": "m - 2 * s"}], ["bb_middle", "bb_upper", "bb_lower"]),
    "ind_bollinger_position": ([{"m": mean("close", 20), "s": std("close", 20)}, {"w": "(m + 2 * s) - (m - 2 * s)"}, {"bollinger_position": clip("CASE WHEN w < 1e-6 THEN 0.5 ELSE (close - (m - 2 * s)) / w END", 0, 1)}], ["bollinger_position"]),
    "ind_cci": ([{"tp": "(high + low + close) / 3"}, {"m": mean("tp", 14)}, {"d": "abs(tp - m)"}, {"cci": f"(tp - m) / (0.015 * {mean('d', 14)})"}], ["cci"]),
    "ind_macd": (_macd("macd", "f - s"), ["macd_12_26", "macd_signal_9", "macd_hist"]),
    "ind_ppo": (_macd("ppo", "(f - s) / s * 100"), ["ppo_12_26", "ppo_signal_9", "ppo_hist"]),
    "ind_price_change_pct": ([{"price_change_pct_1": f"{change('close')} * 100"}], ["price_change_pct_1"]),
    "ind_returns": ([{"returns": change("close")}], ["returns"]),
    "ind_roc": ([{"roc_12": f"{change('close', 12)} * 100"}], ["roc_12"]),
    "ind_rolling_volatility": ([{"close_volatility_12": std("close", 12)}], ["close_volatility_12"]),
    "ind_rsi_sma": ([GAIN, {"rsi_sma_14": f"100 - 100 / (1 + ({mean('g', 14)}) / ({mean('l', 14)} + 1e-10))"}], ["rsi_sma_14"]),
    "ind_sma": ([{"close_sma_20": mean("close", 20)}], ["close_sma_20"]),
    "ind_sma_deviation_std": ([{"d": f"close - {mean('close', 30)}"}, {"sma30_dev_std": std("d", 30)}], ["sma30_dev_std"]),
    "ind_stochastic": ([{"lo": roll("min", "low", 14), "hi": roll("max", "high", 14)}, {"stoch_k": "(close - lo) / (hi - lo) * 100"}, {"stoch_d": mean("stoch_k", 3)}], ["stoch_k", "stoch_d"]),
    "ind_wilder_rsi": ([GAIN, {"a": ewm("g", 1 / 14), "b": ewm("l", 1 / 14)}, {"wilder_rsi_14": "CASE WHEN b = 0 AND a > 0 THEN 100.0 WHEN b = 0 THEN NULL ELSE 100 - 100 / (1 + a / b) END"}], ["wilder_rsi_14"]),
    "ind_window_return": ([{"ret_24": change("close", 24)}], ["ret_24"]),
    "feat_close_position": ([{"close_position": "(close - low) / (high - low + 1e-8)"}], ["close_position"]),
    "feat_position_in_candle": ([{"position_in_candle": "(close - low) / (high - low + 1e-10)"}], ["position_in_candle"]),
    "feat_position_in_range": ([{"position_in_range": "(close - low) / (high - low + 1e-10)"}], ["position_in_range"]),
    "feat_close_to_extremes": ([{"close_to_high": "(close - high) / high", "close_to_low": "(close - low) / low"}], ["close_to_high", "close_to_low"]),
    "feat_range_pct": ([{"range_pct": "(high - low) / close"}], ["range_pct"]),
    "feat_spread": ([{"spread": "(high - low) / close"}], ["spread"]),
    "feat_spread_percent": ([{"spread_percent": "(high - low) / close"}], ["spread_percent"]),
    "feat_dynamic_stop_loss": ([*_DYN, {"v": f"{_vm} * {REGIME_MULT}"}, {"dynamic_stop_loss": clip("v", 0.3 * 0.7, 0.3 * 1.4)}], ["dynamic_stop_loss"]),
    "feat_dynamic_target": ([*_DYN, {"v": f"{_vm} * {REGIME_MULT}"}, {"dynamic_target": clip("v", 0.3 * 0.6, 0.3 * 1.4)}], ["dynamic_target"]),
    "feat_exit_quality": ([{"exit_quality": "CASE WHEN exit_reason IN ('target_hit', 'trailing_stop') AND exit_net_return > 0 THEN 1.0 WHEN exit_reason = 'stop_loss' OR (exit_reason = 'timeout' AND exit_net_return < 0) THEN 0.2 ELSE 0.5 END"}], ["exit_quality"]),
    "feat_regime_multiplier": ([{"regime_multiplier": REGIME_MULT}], ["regime_multiplier"]),
    "feat_risk_reward_ratio": ([{"risk_reward_ratio": "capturable_breakout / (abs(max_drawdown) + 0.001)"}], ["risk_reward_ratio"]),
    "feat_volatility_measure": ([*_DYN, {"volatility_measure": _vm}], ["volatility_measure"]),
    "feat_volatility_1h": ([{"volatility_1h": "rolling_volatility"}], ["volatility_1h"]),
    "feat_feature_aliases": ([{"a": f"({change('close')} > 0)::INT * 0.5 + ({change('close', 3)} > 0)::INT * 0.5", "b": lag("close"), "c": lag("open", 2)}, {"dynamic_target_feature": "coalesce(b, 0.005)", "entry_score_feature": "coalesce(c, 1.0)", "momentum_score_feature": "coalesce(a, 1.0)"}], ["dynamic_target_feature", "entry_score_feature", "momentum_score_feature"]),
    "feat_time_features": ([{"hour": "hour(datetime)", "minute": "minute(datetime)", "weekday": "isodow(datetime)"}], ["hour", "minute", "weekday"]),
    "feat_quantile_flag": ([{"quantile_flag": "(close > 250)::INT"}], ["quantile_flag"]),
    "feat_gap_high": ([{"gap_high": f"(high - {lag('close')}) / {lag('close')}"}], ["gap_high"]),
    "feat_log_returns": ([{"log_returns": f"ln(close / {lag('close')})"}], ["log_returns"]),
    "feat_lag_range_cols": ([{f"{c}_lag_{k}": lag(c, k) for c in ("close", "volume") for k in (1, 2, 3)}], [f"{c}_lag_{k}" for c in ("close", "volume") for k in (1, 2, 3)]),
    "feat_lag_column": ([{"high_lag_4": lag("high", 4), "low_lag_2": lag("low", 2)}], ["high_lag_4", "low_lag_2"]),
    "feat_returns_lags": ([{"returns": change("close")}, {f"returns_lag_{k}": lag("returns", k) for k in (1, 2, 3)}], ["returns", "returns_lag_1", "returns_lag_2", "returns_lag_3"]),
    "feat_micro_momentum": ([{"micro_momentum": change("close", 3)}], ["micro_momentum"]),
    "feat_momentum_periods": ([{f"momentum_{p}": change("close", p) for p in (12, 24, 48)}], ["momentum_12", "momentum_24", "momentum_48"]),
    "feat_momentum_confirmation": ([{"momentum_score": f"({change('close')} > 0)::INT * 0.5 + ({change('close', 3)} > 0)::INT * 0.5"}], ["momentum_score"]),
    "feat_momentum_weight": ([{"momentum_weight": f"({change('close', 12)} > 0)::INT * 0.5 + 0.5"}], ["momentum_weight"]),
    "feat_distance_from_high": ([{"distance_from_high": f"({roll('max', 'high', 24)} - close) / close"}], ["distance_from_high"]),
    "feat_distance_from_low": ([{"distance_from_low": f"(close - {roll('min', 'low', 24)}) / close"}], ["distance_from_low"]),
    "feat_price_range_position": ([{"lo": roll("min", "low", 24), "hi": roll("max", "high", 24)}, {"price_range_position": "(close - lo) / (hi - lo + 1e-10)"}], ["price_range_position"]),
    "feat_atr_sma": ([ATRP, {"atr_sma": mean("tr", 14)}], ["atr_sma"]),
    "feat_atr_percent_sma": ([ATRP, {"atr_percent_sma": f"{mean('tr', 14)} / close"}], ["atr_percent_sma"]),
    "feat_trend_strength": ([{"f": mean("close", 20), "s": mean("close", 50)}, {"trend_strength": "(f - s) / s"}], ["trend_strength"]),
    "feat_sma_ratios": ([{f"m{p}": mean("close", p) for p in (5, 10, 20, 50)}, {**{f"sma_{p}_ratio": f"close / m{p}" for p in (5, 10, 20, 50)}, "close_sma_5": "m5"}], ["sma_5_ratio", "sma_10_ratio", "sma_20_ratio", "sma_50_ratio", "close_sma_5"]),
    "feat_volume_ratio": ([{"volume_ratio": f"volume / {mean('volume', 20)}"}], ["volume_ratio"]),
    "feat_volume_trend": ([{"volume_trend": f"({mean('volume', 12)}) / ({mean('volume', 48)})"}], ["volume_trend"]),
    "feat_volume_weight": ([{"r": f"volume / ({mean('volume', 20)})"}, {"volume_weight": clip("r", 0.5, 2.0)}], ["volume_weight"]),
    "feat_volume_spike": ([{"volume_spike": f"volume / ({mean('volume', 20)})"}], ["volume_spike"]),
    "feat_volume_spike_z": ([{"volume_spike": f"(volume - ({mean('volume', 20)})) / (({std('volume', 20)}) + 1e-10)"}], ["volume_spike"]),
    "feat_volume_regime": ([{"volume_regime": f"({mean('volume', 12)}) / ({mean('volume', 48)})"}], ["volume_regime"]),
    "feat_volatility_weight": ([{"r": change("close")}, {"volatility": std("r", 20)}, {"volatility_weight": clip("2 / (1 + volatility * 100)", 0.3, 1.0)}], ["volatility", "volatility_weight"]),
    "feat_kline_imbalance": ([{"x": "(1 - 2 * maker_ratio) * no_of_trades"}, {"imbalance": f"sum(x) {rows(14)}"}], ["imbalance"]),
    "feat_market_regime": ([{"sma_20": mean("close", 20), "sma_50": mean("close", 50), "volume_sma": mean("volume", 48), "r": change("close"), "vr": mean("volume", 12)}, {"trend_strength": "(sma_20 - sma_50) / sma_50", "volatility_ratio": f"({std('r', 12)}) / ({std('r', 48)})", "volume_regime": "vr / volume_sma"}, {"market_favorable": "((trend_strength > -0.001)::INT + (volatility_ratio < 2.0)::INT + (volume_regime > 0.7)::INT) / 3.0"}], ["sma_20", "sma_50", "volume_sma", "trend_strength", "volatility_ratio", "volume_regime", "market_favorable"]),
    "feat_entry_score": (
        [{"sp": "(high - low) / close", "mm": change("close", 3), "vs": f"volume / ({mean('volume', 20)})"}, {"sr": f"sp / ({mean('sp', 48)})"}, {"t0": "1 - (close - low) / (high - low + 1e-10)", "t1": "(mm > 0)::INT", "t2": f"({clip('vs', 0.5, 1.5)}) / 1.5", "t3": f"1 - ({clip('sr', 0, 2)})"},
         {"entry_score": f"CASE volatility_regime WHEN 'low' THEN {_score((0.35, 0.15, 0.15, 0.35))} WHEN 'high' THEN {_score((0.15, 0.35, 0.35, 0.15))} ELSE {_score((0.25,) * 4)} END"}], ["entry_score"]),
    "feat_ichimoku": ([{f"x{n}": f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2" for n in (9, 26, 52)}, {"tenkan": "x9", "kijun": "x26", "a": "(x9 + x26) / 2"}, {"senkou_a": lag("a", -26), "senkou_b": lag("x52", -26), "chikou": lag("close", 26)}], ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"]),
    "feat_sma_crossover": ([{"s": mean("close", 10), "l": mean("close", 30)}, {"side": "(s > l)::INT - (s < l)::INT"}, {"crossover": f"side - {lag('side')}"}, {"signal": "CASE crossover WHEN 2 THEN 1 WHEN -2 THEN -1 ELSE 0 END"}], ["crossover", "signal"]),
    "feat_vwap": ([{"vwap": "sum(close * volume) OVER z / sum(volume) OVER z"}], ["vwap"]),
    "feat_ema_alignment": ([{"ema": ewm("close", A(21))}, {"c": clip("1 - abs(close - ema) / ema", 0, 1)}, {"ema_alignment": "pow(c, 2.0)"}], ["ema", "ema_alignment"]),
    "feat_breakout_features": (
        [{f"{s}_t-{k}": lag(c, k) for s, c in _sides.items() for k in range(12, 24)},
         {**{f"{s}_roll_mean": mean(f'"{s}_t-12"', 12) for s in _sides}, **{f"{s}_roll_std": std(f'"{s}_t-12"', 12) for s in _sides}, **{f"roc_{s}_12_1": f'CASE WHEN "{s}_t-13" <> 0 THEN ("{s}_t-12" - "{s}_t-13") / "{s}_t-13" * 100 ELSE 0 END' for s in _sides}}],
        ["long_t-12", "short_t-23", "long_roll_mean", "long_roll_std", "short_roll_mean", "short_roll_std", "roc_long_12_1", "roc_short_12_1"],
        '"long_t-23" IS NOT NULL AND long_roll_mean IS NOT NULL AND long_roll_std IS NOT NULL'),
    "target_forward_breakout": ([{"b": f"((({lag('close', -24)}) - close) / close >= 0.02)::INT"}, {"forward_breakout": lag("b", -1)}], ["forward_breakout"]),
    "target_ema_breakout": ([{"e": ewm("close", A(30)), "x": lag("close", -3)}, {"breakout_ema": "(x > e * 1.2)::INT"}], ["breakout_ema"], "breakout_ema IS NOT NULL"),
    "regime_ma_slope": ([{"m": mean("close", 24), "s": std("close", 24)}, {"k": f"(m - {lag('m', 24)}) / 24 / (s + 1e-12)"}, _updown("regime_ma_slope", "k > 0", "k < 0")], ["=regime_ma_slope"]),
    "regime_price_band": ([{"m": mean("close", 24), "s": std("close", 24)}, _updown("regime_price_band", "close > m + 0.75 * s", "close < m - 0.75 * s")], ["=regime_price_band"]),
    "regime_price_band_dev": ([{"m": mean("close", 24)}, {"d": "close - m"}, {"s": std("d", 24)}, _updown("regime_price_band", "close > m + 0.75 * s", "close < m - 0.75 * s")], ["=regime_price_band"]),
    "regime_breakout_pct": ([{"lo": roll("min", "low", 24), "hi": roll("max", "high", 24)}, {"price_range_position": "(close - lo) / (hi - lo + 1e-10)"}, _updown("regime_breakout_pct", "price_range_position >= 0.85", "price_range_position <= 0.15")], ["price_range_position", "=regime_breakout_pct"]),
    "regime_window_return": ([{"ret_24": change("close", 24)}, _updown("regime_window_return", "ret_24 >= 0", "ret_24 <= 0")], ["ret_24", "=regime_window_return"]),
    "regime_hh_hl": ([{"h1": lag("high"), "l1": lag("low")}, {"p": "(high > h1)::INT + (low > l1)::INT - (high < h1)::INT - (low < l1)::INT"}, {"s": roll("sum", "p", 24)}, _updown("regime_hh_hl", "s >= 4", "s <= -4")], ["=regime_hh_hl"]),
}

ROWS = f"SELECT *, row_number() OVER (PARTITION BY series ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY series) AS cnt FROM ({K})"
SPLIT = f"SELECT *, CASE WHEN i < floor(cnt * 8 / 11) THEN 'train' WHEN i < floor(cnt * 8 / 11) + floor(cnt * 1 / 11) THEN 'val' ELSE 'test' END AS split FROM ({ROWS})"
SPANS = f"WITH r AS ({ROWS}), s AS (SELECT series, i - 3 AS a, i + floor(close)::BIGINT % 12 AS b FROM r WHERE i % 7 = 0)"
_all = lambda: ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in KLINE)


def _r(expr: str, name: str) -> str:
    return f'round(CASE WHEN isfinite(({expr})::DOUBLE) THEN ({expr})::DOUBLE END, 6) AS "{name}"'


def _span(name: str, expr: str) -> str:
    return f"{SPANS} SELECT series, i, round(({expr})::DOUBLE, 6) AS {name} FROM r"


def _bars(column: str, threshold: float) -> str:
    return f"""WITH RECURSIVE k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datetime) AS n FROM ({K})),
w AS (SELECT series, n, {column}::DOUBLE AS cum, 0 AS g FROM k WHERE n = 1 UNION ALL
  SELECT k.series, k.n, CASE WHEN w.cum >= {threshold} THEN k.{column} ELSE w.cum + k.{column} END, CASE WHEN w.cum >= {threshold} THEN w.g + 1 ELSE w.g END FROM w JOIN k ON k.series = w.series AND k.n = w.n + 1),
d AS (SELECT series, coalesce(epoch(max(datetime) FILTER (n = 2)) - epoch(max(datetime) FILTER (n = 1)), 0) AS base_interval FROM k GROUP BY series),
b AS (SELECT series, g, min(datetime) AS datetime, arg_min(open, n) AS open, max(high) AS high, min(low) AS low, arg_max(close, n) AS close, sum(volume) AS volume, sum(no_of_trades) AS no_of_trades, sum(liquidity_sum) AS liquidity_sum,
  sum(maker_ratio * no_of_trades) / sum(no_of_trades) AS maker_ratio, sum(maker_volume) AS maker_volume, sum(maker_liquidity) AS maker_liquidity, sum(mean * no_of_trades) / sum(no_of_trades) AS mean, count(*) AS bar_count, sum({column}) AS total
  FROM k JOIN w USING (series, n) GROUP BY 1, 2)
SELECT series, datetime, {', '.join(_r(c, c) for c in ('open', 'high', 'low', 'close', 'volume', 'no_of_trades', 'liquidity_sum', 'maker_ratio', 'maker_volume', 'maker_liquidity', 'mean', 'bar_count', 'base_interval'))} FROM b JOIN d USING (series) WHERE total >= {threshold}"""


CFR = """WITH t AS (SELECT event_id, ts, floor(epoch(ts))::BIGINT AS s, value + 1 AS price, (props::JSON ->> '$.k')::DOUBLE + 1 AS q FROM events), u AS (SELECT *, price * q AS v, s - s % 3600 AS b FROM t),
kl AS (SELECT b, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(q) AS volume, sum(v) AS vs FROM u GROUP BY b),
n AS (SELECT b, k, s // (60 * (1 << k)) AS n, v, sum(v) OVER (PARTITION BY b, k, s // (60 * (1 << k))) AS f FROM u, range(6) r(k)),
bins AS (SELECT b, k, n, max(f) AS f, -sum(v / f * log2(v / f)) AS e FROM n GROUP BY ALL),
sc AS (SELECT b, k, stddev_pop(f) / avg(f) AS r, avg(e) AS e FROM bins GROUP BY b, k HAVING count(*) >= 2),
m AS (SELECT *, avg(r) OVER (PARTITION BY b) AS rm, first_value(e) OVER (PARTITION BY b ORDER BY k) AS e0 FROM sc),
f AS (SELECT b, avg(r) AS flux_rel_std_mean, var_pop(r) AS flux_rel_std_var, avg(e) AS entropy_mean, var_pop(e) AS entropy_var, sqrt(avg((r - rm) ** 2)) AS dflux_rms, sqrt(avg((e - (e0 - k)) ** 2)) AS dentropy_rms FROM m GROUP BY b)
SELECT 'all' AS series, make_timestamp(b * 1000000) AS datetime, """ + ", ".join(_r(c, c) for c in ("open", "high", "low", "close", "volume")) + ", " + _r("vs / volume", "vwap") + ", " + ", ".join(_r(c, c) for c in ("flux_rel_std_mean", "flux_rel_std_var", "entropy_mean", "entropy_var", "dflux_rms", "dentropy_rms")) + " FROM kl LEFT JOIN f USING (b)"

PRED = f"""SELECT *, (up > close)::INT AS actual, (close < m)::INT AS prediction, round(m / (close + m), 2) AS proba, up AS target, close - open AS price_change, series AS round_id
  FROM (SELECT *, {lag('close', -1)} AS up, {mean('close', 5)} AS m FROM ({K})) WHERE up IS NOT NULL AND m IS NOT NULL"""
_auc = lambda y, s, src: f"SELECT round_id, (sum(CASE WHEN {y} = 1 THEN rk END) - sum(({y} = 1)::INT) * (sum(({y} = 1)::INT) + 1) / 2.0) / (sum(({y} = 1)::INT) * sum(({y} <> 1)::INT)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY round_id ORDER BY {s}) + (count(*) OVER (PARTITION BY round_id, {s}) - 1) / 2.0 AS rk FROM ({src})) GROUP BY round_id"
_FIT = ("close", "volume", "std")


def _fitted(select: str, agg: str, where: str = "") -> str:
    return f"WITH k AS ({K}), f AS (SELECT series, {agg} FROM k GROUP BY series) SELECT series, datetime, {select} FROM k JOIN f USING (series) {where}"


def _scale(c: str, log: bool = False) -> str:
    x = f"ln(1 + {c})" if log else c
    return f"({x} - (SELECT avg({x}) FROM p t WHERE t.split = 'train' AND t.series = p.series)) / (SELECT stddev_pop({x}) FROM p t WHERE t.split = 'train' AND t.series = p.series)"


CONFUSION = f"""WITH p0 AS ({PRED}), q AS (SELECT round_id, quantile_cont(price_change, 0.01) AS lo, quantile_cont(price_change, 0.99) AS hi FROM p0 GROUP BY 1),
p AS (SELECT p0.*, price_change AS x, prediction = 1 AND actual = 1 AS tp, prediction = 1 AND actual = 0 AS fp, prediction = 0 AND actual = 1 AS fn FROM p0 JOIN q USING (round_id) WHERE price_change BETWEEN lo AND hi),
a AS (SELECT round_id, count(*) FILTER (tp) AS ntp, count(*) FILTER (fp) AS nfp, count(*) FILTER (fn) AS nfn, count(*) AS n, avg(x) FILTER (tp) AS mtp, avg(x) FILTER (fp) AS mfp, median(x) FILTER (tp) AS dtp, median(x) FILTER (fp) AS dfp,
  avg(x) FILTER (prediction = 1) AS mp, median(x) FILTER (prediction = 1) AS dp, var_samp(x) FILTER (tp) AS vtp, var_samp(x) FILTER (fp) AS vfp FROM p GROUP BY 1),
v AS (SELECT DISTINCT round_id, x FROM p WHERE tp OR fp),
ks AS (SELECT v.round_id, max(abs((SELECT count(*) FROM p WHERE p.round_id = v.round_id AND tp AND p.x <= v.x) / a.ntp - (SELECT count(*) FROM p WHERE p.round_id = v.round_id AND fp AND p.x <= v.x) / a.nfp)) AS ks FROM v JOIN a USING (round_id) GROUP BY 1)
SELECT round_id, {_r('(ntp + nfp) / n * 100', 'pred_pos_rate_pct')}, {_r('(ntp + nfn) / n * 100', 'actual_pos_rate_pct')}, {_r('ntp / (ntp + nfp) * 100', 'precision_pct')}, {_r('ntp / (ntp + nfn) * 100', 'recall_pct')},
  {_r('mtp', 'tp_x_mean')}, {_r('mfp', 'fp_x_mean')}, {_r('dtp', 'tp_x_median')}, {_r('dfp', 'fp_x_median')}, {_r('ntp + nfp', 'pred_pos_count')}, {_r('mp', 'pred_pos_x_mean')}, {_r('dp', 'pred_pos_x_median')},
  {_r('ntp', 'tp_count')}, {_r('nfp', 'fp_count')}, {_r('(mtp - mfp) / sqrt(((ntp - 1) * vtp + (nfp - 1) * vfp) / (ntp + nfp - 2))', 'tp_fp_cohen_d')}, {_r('ks', 'tp_fp_ks')}, {_r('n', 'n_kept')} FROM a JOIN ks USING (round_id)"""

_WR = "OVER (PARTITION BY round_id ORDER BY datetime"
SNAPSHOT = f"""WITH p AS (SELECT *, prediction = 1 AND open <> 0 AS held FROM ({PRED})), a AS (SELECT *, coalesce(lag(held) {_WR}), false) AS b4, coalesce(lead(held) {_WR}), false) AS af, lag(close) {_WR}) AS c1 FROM p),
g AS (SELECT *, coalesce(CASE WHEN held AND NOT b4 THEN price_change / open WHEN held THEN close / c1 - 1 ELSE 0.0 END, 0.0) AS gross FROM a),
r AS (SELECT *, gross - CASE WHEN held AND NOT af THEN 0.002 ELSE 0 END AS net FROM g),
e AS (SELECT *, product(1 + gross) {_WR} ROWS UNBOUNDED PRECEDING) AS eg, product(1 + net) {_WR} ROWS UNBOUNDED PRECEDING) AS en FROM r),
d AS (SELECT *, en / max(en) {_WR} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT round_id, {_r('count(*) FILTER (held AND net > 0) / count(*) FILTER (held) * 100', 'trade_win_rate_pct')}, {_r('avg(net) FILTER (held) * 100', 'trade_expectancy_pct')}, {_r('min(dd) * 100', 'max_drawdown_pct')},
  {_r('(arg_max(eg, datetime) - 1) * 100', 'total_return_gross_pct')}, {_r('(arg_max(en, datetime) - 1) * 100', 'total_return_net_pct')}, {_r('avg(net) FILTER (held AND net > 0) * 100', 'trade_return_mean_win_pct')}, {_r('avg(net) FILTER (held AND net < 0) * 100', 'trade_return_mean_loss_pct')},
  {_r('count(*)', 'bars_total')}, {_r('avg(net) / stddev_samp(net)', 'sharpe_per_bar')}, {_r('count(*) FILTER (held) / count(*) * 100', 'bars_in_market_pct')}, {_r('count(*) FILTER (held)', 'trades_count')}, {_r('20', 'cost_round_trip_bps')} FROM d GROUP BY round_id"""

_ROC4 = "(close / lag(close, 4) OVER (PARTITION BY series, split ORDER BY datetime) - 1) * 100"


def _slice_start() -> int:
    import numpy as np

    return int(np.random.default_rng(3).integers(50, 350 + 1))


def _threshold(score: str = "tp / pp * sqrt(pp / n)", name: str = "balanced", proba: str = "proba") -> str:
    """The best of the tried thresholds (the first of equal ones), or 0.35 and -1 where none gives a positive."""
    import numpy as np

    tried = ", ".join(f"{t!r}::DOUBLE" for t in np.arange(0.20, 0.70 + 0.05, 0.05).tolist())
    return f"""WITH p AS (SELECT round_id, actual, {proba} AS q FROM ({PRED})), s AS (SELECT round_id, t, count(*) FILTER (q >= t AND actual = 1) AS tp, count(*) FILTER (q >= t) AS pp, count(*) FILTER (actual = 1) AS yes, count(*) AS n
  FROM p, (SELECT unnest([{tried}]) AS t) GROUP BY 1, 2), b AS (SELECT *, CASE WHEN pp > 0 THEN {score} END AS m FROM s)
SELECT round_id, {_r('coalesce(arg_max(t, (m, -t)) FILTER (m IS NOT NULL), 0.35)', 'threshold')}, {_r('coalesce(max(m), -1)', name)} FROM b GROUP BY 1"""


def _iqr(base: str, columns: list[str], factor: float) -> str:
    """Outliers column after column; equal quartiles filter nothing."""
    sql, name = f"WITH x0 AS ({base})", "x0"
    for i, c in enumerate(columns, 1):
        sql += f", q{i} AS (SELECT {near(c, 0.25)} AS l, {near(c, 0.75)} AS h FROM {name}), x{i} AS (SELECT {name}.* FROM {name}, q{i} WHERE l = h OR {c} BETWEEN l - {factor} * (h - l) AND h + {factor} * (h - l))"
        name = f"x{i}"
    return f"{sql} SELECT series, datetime, {', '.join(_r(c, c) for c in columns)} FROM {name}"


#: Isotonic regression as the greatest of least means: y(i) = max over a <= i of min over b >= i of the mean of a..b; then a line between points.
CALIBRATED = f"""WITH p AS ({PRED}), v AS (SELECT round_id, proba AS x, count(*)::DOUBLE AS n, sum(actual)::DOUBLE AS g FROM p WHERE hour(datetime) % 2 = 0 GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(g) OVER w AS cg FROM v WINDOW w AS (PARTITION BY round_id ORDER BY x)),
m AS (SELECT k.round_id, k.i, a.i AS lo, min((b.cg - a.cg + a.g) / (b.cn - a.cn + a.n)) AS least FROM c k JOIN c a ON a.round_id = k.round_id AND a.i <= k.i JOIN c b ON b.round_id = k.round_id AND b.i >= k.i GROUP BY 1, 2, 3),
y AS (SELECT round_id, i, max(least) AS y FROM m GROUP BY 1, 2),
t AS (SELECT round_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c JOIN y USING (round_id, i) WINDOW w AS (PARTITION BY round_id ORDER BY x)),
f AS (SELECT round_id, min(y) AS first FROM y GROUP BY 1)
SELECT p.round_id, p.datetime, {_r('CASE WHEN t.x IS NULL THEN f.first WHEN nx IS NULL THEN t.y ELSE t.y + (ny - t.y) * (p.proba - t.x) / (nx - t.x) END', 'calibrated')}
FROM p ASOF LEFT JOIN t ON p.round_id = t.round_id AND p.proba >= t.x JOIN f ON f.round_id = p.round_id"""

SPLIT_RANDOM = f"""WITH r AS (SELECT series, datetime, row_number() OVER (PARTITION BY series ORDER BY md5('7:' || datetime::VARCHAR), datetime) - 1 AS p, count(*) OVER (PARTITION BY series) AS n FROM ({K}))
SELECT series, datetime, CASE WHEN p < floor(n * 8 / 11) THEN 'train' WHEN p < floor(n * 8 / 11) + floor(n * 1 / 11) THEN 'val' ELSE 'test' END AS split FROM r"""

PREPARED = f"""WITH p AS (SELECT series, datetime, split, close, volume, {_ROC4} AS x FROM ({SPLIT})), c AS (SELECT series, {near('x', 1.0 - 0.3)} AS cut FROM p WHERE split = 'train' GROUP BY series),
f AS (SELECT p.*, (x > cut)::INT AS y FROM p JOIN c USING (series)), g AS (SELECT *, lead(y) OVER (PARTITION BY series, split ORDER BY datetime) AS flag FROM f), k AS (SELECT * FROM g WHERE x IS NOT NULL AND flag IS NOT NULL),
s AS (SELECT series, avg(close) AS mc, stddev_pop(close) AS sc, avg(ln(1 + volume)) AS mv, stddev_pop(ln(1 + volume)) AS sv FROM k WHERE split = 'train' GROUP BY series)
SELECT series, datetime, split, {_r('(close - mc) / sc', 'close')}, {_r('(ln(1 + volume) - mv) / sv', 'volume')}, {_r('x', 'roc_4')}, {_r('flag', 'flag')} FROM k JOIN s USING (series)"""


def _graph() -> str:
    """The rounds of manifest_graph, each for itself."""
    one = """SELECT {i} AS round_id, series, datetime, split, close, volume, x AS roc, flag FROM (SELECT *, lead(y, {ahead}) OVER (PARTITION BY series, split ORDER BY datetime) AS flag FROM
  (SELECT p.*, (x > cut)::INT AS y FROM ({rows}) p JOIN (SELECT series, {cut} AS cut FROM ({rows}) WHERE split = 'train' GROUP BY series) USING (series))) WHERE x IS NOT NULL AND flag IS NOT NULL"""
    rounds = [(p, q, ahead) for p in (1, 4) for q in (0.3, 0.4) for ahead in (1, 2)]
    roc = lambda p: f"SELECT series, datetime, split, close, volume, (close / lag(close, {p}) OVER (PARTITION BY series, split ORDER BY datetime) - 1) * 100 AS x FROM ({SPLIT})"
    every = " UNION ALL ".join(one.format(i=i, rows=roc(p), cut=near("x", 1.0 - q), ahead=ahead) for i, (p, q, ahead) in enumerate(rounds))
    return f"SELECT round_id, series, datetime, split, {', '.join(_r(c, c) for c in ('close', 'volume', 'roc', 'flag'))} FROM ({every})"


TICKS = f"SELECT datetime, trade_id, price, quantity FROM ({TRADES})"


def _tick(f: str, c: str, n: int) -> str:
    w = f"OVER (ORDER BY datetime, trade_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} = {n} THEN {f}({c}) {w} END"


_T, _SO_FAR = "OVER (ORDER BY datetime, trade_id)", "OVER (ORDER BY datetime, trade_id ROWS UNBOUNDED PRECEDING)"
LONG_ROLLING = f"""WITH t AS ({TICKS}), w AS (SELECT *, {_tick('avg', 'price', 20)} AS mean_20, {_tick('stddev_samp', 'price', 20)} AS std_20, price / lag(price, 12) {_T} - 1 AS change_12,
  {_tick('max', 'price', 50)} AS top_50, lead(price, 5) {_T} AS ahead_5 FROM t), d AS (SELECT *, {_tick('stddev_samp', 'mean_20', 10)} AS dev_std FROM w)
SELECT datetime, trade_id, {', '.join(_r(c, c) for c in ('mean_20', 'std_20', 'change_12', 'top_50', 'ahead_5', 'dev_std'))} FROM d"""
LONG_RUNNING = f"""WITH t AS ({TICKS}), g AS (SELECT *, price / lag(price) {_T} AS gross, CASE WHEN quantity > 5 THEN price END AS large FROM t)
SELECT datetime, trade_id, round((sum(quantity) {_SO_FAR})::DOUBLE, 4) AS total, round((max(price) {_SO_FAR})::DOUBLE, 4) AS top, round((count(large) {_SO_FAR})::DOUBLE, 4) AS n_large,
  round((product(gross) {_SO_FAR})::DOUBLE, 4) AS equity, round((last_value(large IGNORE NULLS) {_SO_FAR})::DOUBLE, 4) AS last_large FROM g"""
#: The weights of rows further back than 600 are below the rounding.
LONG_EWM = f"""WITH t AS ({TICKS}) SELECT datetime, trade_id, {', '.join(f"round(list_reduce(list({c}::DOUBLE) OVER (ORDER BY datetime, trade_id ROWS 600 PRECEDING), lambda x, y: {1 - a!r} * x + {a!r} * y), 6) AS {n}" for n, c, a in (('ewm_14', 'price', 1 / 14), ('ewm_3', 'quantity', 1 / 3)))} FROM t"""


def _asof(kind: str) -> str:
    bars = f"SELECT series, datetime AS bar_time, close FROM ({klines()}) WHERE close > mean"
    one = lambda sign: f"SELECT t.*, b.bar_time, b.close FROM ({TRADES}) t ASOF LEFT JOIN b ON t.series = b.series AND t.datetime {sign} b.bar_time"
    if kind == "nearest":
        found = f"""SELECT p.trade_id, p.price, CASE WHEN later THEN n.bar_time ELSE p.bar_time END AS bar_time, CASE WHEN later THEN n.close ELSE p.close END AS close
  FROM ({one('>=')}) p JOIN ({one('<=')}) n USING (trade_id), LATERAL (SELECT n.bar_time IS NOT NULL AND (p.bar_time IS NULL OR epoch_us(n.bar_time) - epoch_us(n.datetime) < epoch_us(n.datetime) - epoch_us(p.bar_time)) AS later)"""
    elif kind == "forward":
        found = f"SELECT * REPLACE (CASE WHEN near THEN bar_time END AS bar_time, CASE WHEN near THEN close END AS close) FROM (SELECT *, bar_time - datetime <= INTERVAL 6 HOUR AS near FROM ({one('<')}))"
    else:
        found = one(">=")
    return f"WITH b AS ({bars}) SELECT trade_id, bar_time, {_r('price', 'price')}, {_r('close', 'close')} FROM ({found})"


INTERVALS = f"""WITH s AS (SELECT series, datetime AS start, datetime + INTERVAL 1 HOUR * (no_of_trades % 10) AS stop FROM ({klines()}))
SELECT s.series, start, round(count(*)::DOUBLE, 6) AS n, {_r('sum(quantity)', 'quantity')}, {_r('max(price)', 'top')} FROM s JOIN ({TRADES}) t ON t.series = s.series AND t.datetime >= start AND t.datetime < stop GROUP BY ALL"""


_SUMMARY = f"""{_r('arg_min(price, trade_id)', 'open')}, {_r('max(price)', 'high')}, {_r('min(price)', 'low')}, {_r('arg_max(price, trade_id)', 'close')}, {_r('sum(quantity)', 'volume')},
  {_r('sum(price * quantity)', 'liquidity_sum')}, {_r('avg(is_buyer_maker::INT)', 'maker_ratio')}, {_r('count(*)', 'no_of_trades')}"""
SLIDING = f"""SELECT series, start AS datetime, start + INTERVAL 3600 SECOND AS "end", {_SUMMARY} FROM
  (SELECT *, time_bucket(INTERVAL 900 SECOND, datetime, TIMESTAMP '1970-01-01') - INTERVAL 900 SECOND * k AS start FROM ({TRADES}), range(4) r(k)) GROUP BY series, start"""
SESSIONS = f"""WITH m AS (SELECT *, coalesce(lag(datetime) OVER (PARTITION BY series ORDER BY datetime) + INTERVAL 1200 SECOND < datetime, true)::INT AS new FROM ({TRADES})),
g AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY datetime) AS s FROM m)
SELECT series, min(datetime) AS datetime, max(datetime) + INTERVAL 1200 SECOND AS "end", {_SUMMARY} FROM g GROUP BY series, s"""


#: The account's state bar by bar: money, sums bought and sold, credit and debit.
SEQUENTIAL = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT round_id, open, close, row_number() OVER (PARTITION BY round_id ORDER BY datetime) AS n FROM ({PRED}) WHERE prediction = 1 AND open > 0 AND close > 0),
w AS (SELECT DISTINCT round_id, 0::BIGINT AS n, 30000.0::DOUBLE AS usdt, 0.0::DOUBLE AS bought, 0.0::DOUBLE AS sold, 30000.0::DOUBLE AS credit, 0.0::DOUBLE AS debit, 0.0::DOUBLE AS stake, 0.0::DOUBLE AS gain, false AS traded FROM ({PRED})
  UNION ALL SELECT round_id, n, CASE WHEN go THEN round(credit2 - debit2, 2) ELSE usdt END, CASE WHEN go THEN bought2 ELSE bought END, CASE WHEN go THEN sold + round(amount / close, 15) ELSE sold END,
    CASE WHEN go THEN credit2 ELSE credit END, CASE WHEN go THEN debit2 ELSE debit END, stake2, round(credit2 - debit2, 2) - usdt, go
  FROM (SELECT *, credit + amount AS credit2, debit + stake2 AS debit2 FROM (SELECT *, gross - gross * 0.001::DOUBLE AS amount FROM (SELECT *, (bought2 - sold) * close AS gross FROM
    (SELECT w.*EXCLUDE (n, stake, gain, traded), a.n, a.close, usdt > 1 AS go, usdt - usdt * 0.001::DOUBLE AS stake2, bought + round((usdt - usdt * 0.001::DOUBLE) / a.open, 15) AS bought2 FROM w JOIN a ON a.round_id = w.round_id AND a.n = w.n + 1))))),
t AS (SELECT *, max(usdt) OVER (PARTITION BY round_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS peak, coalesce(lag(usdt) OVER (PARTITION BY round_id ORDER BY n), 30000.0) AS before, count(*) OVER (PARTITION BY round_id) AS trades FROM w WHERE traded),
m AS (SELECT round_id, arg_max(usdt, n) - 30000 AS pnl, avg((gain > 0)::INT) AS win_rate, max((peak - usdt) / peak) AS max_drawdown, avg(gain) AS expected_value,
  CASE WHEN max(trades) > 1 AND stddev_samp((usdt - before) / before) > 0 THEN avg((usdt - before) / before) / stddev_samp((usdt - before) / before) END AS sharpe_ratio, sum(stake) AS volume FROM t GROUP BY round_id)
SELECT round_id, {', '.join(f"coalesce(round({e}, 2), 0)::DOUBLE AS {n}" for n, e in (('pnl', 'pnl'), ('win_rate', 'win_rate'), ('max_drawdown', 'max_drawdown'), ('expected_value', 'expected_value'), ('sharpe_ratio', 'sharpe_ratio'), ('net_long_volume', 'volume'), ('net_short_volume', '0.0'), ('net_trade_volume', 'volume')))}
FROM (SELECT DISTINCT round_id FROM ({PRED})) LEFT JOIN m USING (round_id)"""


def _flagship() -> str:
    bars = klines(3600, f"SELECT * REPLACE ('all' AS series) FROM ({TRADES})")
    split = f"SELECT * EXCLUDE (series), CASE WHEN i < floor(cnt * 8 / 11) THEN 'train' WHEN i < floor(cnt * 8 / 11) + floor(cnt * 1 / 11) THEN 'val' ELSE 'test' END AS series FROM (SELECT *, row_number() OVER (ORDER BY datetime) - 1 AS i, count(*) OVER () AS cnt FROM ({bars}))"
    day = "OVER (PARTITION BY series, datetime::DATE ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    steps = [{"tr": TR, "x": "(1 - 2 * maker_ratio) * no_of_trades"}, {"roc_4": f"{change('close', 4)} * 100", "atr_14": ewm("tr", 1 / 14), "vwap": f"sum(close * volume) {day} / sum(volume) {day}", "imbalance": f"sum(x) {rows(14)}"}]
    steps += [{"flag": f"(roc_4 > (SELECT {near('roc_4', 1.0 - 0.3)} FROM b2 WHERE series = 'train'))::INT"}, {"quantile_flag": lag("flag", -1), "split": "series", "one": "'all'"}]
    out = stages(split, steps, ["close", "roc_4", "atr_14", "vwap", "imbalance", "quantile_flag"], keys="one AS series, datetime, split", where="roc_4 IS NOT NULL AND atr_14 IS NOT NULL AND imbalance IS NOT NULL AND quantile_flag IS NOT NULL")
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (steps, result, *where) in OVER_KLINES.items():
        sql = stages(EXT, steps, result, where=where[0] if where else "")
        out[name] = sql.replace("OVER z", "OVER (PARTITION BY series, datetime::DATE ORDER BY datetime ROWS UNBOUNDED PRECEDING)")
    sized = lambda src: f"SELECT series, datetime, {_all()} FROM ({src})"
    by_type = klines(3600, TRADES.replace("'u' || (user_id % 4)::VARCHAR AS series", "event_type AS series"))
    start = _slice_start()
    counts = "count(*) FILTER (actual = 1 AND prediction = 1) AS tp, count(*) FILTER (actual <> 1 AND prediction = 1) AS fp, count(*) FILTER (actual = 1 AND prediction <> 1) AS fn, count(*) FILTER (actual <> 1 AND prediction <> 1) AS tn, count(*) AS n"
    cls = f"SELECT round_id, (floor(target)::BIGINT % 3)::INT AS actual, (floor(close)::BIGINT % 3)::INT AS prediction, open, close, volume FROM ({PRED})"
    out |= {
        "trades_month": f"SELECT trade_id, datetime, price, quantity FROM ({TRADES}) WHERE datetime >= TIMESTAMP '2024-01-01' AND datetime < TIMESTAMP '2024-02-01'",
        "trades_latest": f"SELECT trade_id, price, quantity FROM ({TRADES}) ORDER BY date_trunc('day', datetime) DESC, trade_id DESC LIMIT 100",
        "trades_sample": f"SELECT trade_id, price, quantity FROM ({TRADES}) ORDER BY md5(trade_id::VARCHAR || ':' || (epoch_us(datetime) // 1000)::VARCHAR), trade_id LIMIT 100",
        "ts_normalise": f"SELECT trade_id, (epoch_us(datetime) // 1000) AS timestamp, date_trunc('milliseconds', datetime)::TIMESTAMP AS datetime FROM ({TRADES})",
        "klines_1h": sized(K), "klines_4h": sized(klines(14400)), "klines_by_type": sized(by_type), "klines_first": f"{sized(K)} WHERE datetime >= TIMESTAMP '2024-01-05' ORDER BY datetime, series LIMIT 50", "klines_newest": f"{sized(klines(7200))} ORDER BY datetime DESC, series LIMIT 50",
        "bars_volume": _bars("volume", 2000), "bars_trade": _bars("no_of_trades", 40), "bars_liquidity": _bars("liquidity_sum", 500000), "cfr_1h": CFR,
        "span_active_lines": _span("active_lines", "SELECT count(*) FROM s WHERE s.series = r.series AND r.i BETWEEN s.a AND s.b"),
        "span_active_quantile_count": _span("active_quantile_count", "SELECT count(*) FROM s WHERE s.series = r.series AND r.i >= s.a AND r.i < s.b"),
        "span_since_big_move": _span("hours_since_big_move", "least(168, coalesce(r.i - (SELECT max(b) FROM s WHERE s.series = r.series AND s.b < r.i), 168))"),
        "span_since_quantile_line": _span("hours_since_quantile_line", "least(168, coalesce(r.i - (SELECT max(b) FROM s WHERE s.series = r.series AND s.b <= r.i), 168))"),
        "span_density": _span("quantile_line_density_48h", "SELECT count(*) FROM s WHERE s.series = r.series AND s.b BETWEEN r.i - 48 AND r.i"),
        "split_sequential": f"SELECT series, datetime, split FROM ({SPLIT})",
        "random_slice": f"SELECT series, i, round(close, 6) AS close FROM ({ROWS}) WHERE i >= {start} AND i < {start + 100}",
        "missing_datetimes": f"SELECT series, datetime FROM ({ROWS}) WHERE i < 5",
        "target_quantile_flag": f"WITH p AS (SELECT *, {_ROC4} AS x FROM ({SPLIT})), c AS (SELECT series, {near('x', 1.0 - 0.3)} AS cut FROM p WHERE split = 'train' GROUP BY series), f AS (SELECT p.*, (x > cut)::INT AS y FROM p JOIN c USING (series)) SELECT series, datetime, split, round((lead(y) OVER (PARTITION BY series, split ORDER BY datetime))::DOUBLE, 6) AS quantile_flag FROM f",
        "shift_column": f"SELECT series, datetime, round({lag('close', 2)}, 6) AS close, round(volume, 6) AS volume, round(std, 6) AS std FROM ({K})",
        "zscore": _fitted(", ".join(_r(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END", c) for c in _FIT), ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _FIT)),
        "mad": _fitted(", ".join(_r(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END", c) for c in _FIT), ", ".join(f"median({c}) AS m_{c}, mad({c}) AS s_{c}" for c in _FIT)),
        "winsorize": _fitted(", ".join(_r(f"least(greatest({c}, l_{c}), h_{c})", c) for c in _FIT), ", ".join(f"{near(c, 0.01)} AS l_{c}, {near(c, 0.99)} AS h_{c}" for c in _FIT)),
        "quantile_trim": _fitted(", ".join(_r(c, c) for c in _FIT), ", ".join(f"{near(c, 0.05)} AS l_{c}, {near(c, 0.95)} AS h_{c}" for c in _FIT), "WHERE " + " AND ".join(f"{c} BETWEEN l_{c} AND h_{c}" for c in _FIT)),
        "scaler_linear": f"WITH p AS ({SPLIT}) SELECT series, datetime, {_r(_scale('close'), 'close')}, {_r(_scale('volume', True), 'volume')}, {_r('maker_ratio', 'maker_ratio')}, {_r(_scale('std'), 'std')} FROM p",
        "scaler_inverse": f"SELECT series, datetime, {_r('close', 'close')}, {_r('volume', 'volume')}, {_r('maker_ratio', 'maker_ratio')}, {_r('std', 'std')} FROM ({K})",
        "scaler_logreg": f"WITH p AS ({SPLIT}) SELECT series, datetime, {_r(_scale('close'), 'close')}, {_r(_scale('volume', True), 'volume')}, {_r('maker_ratio', 'wilder_rsi')}, {_r('std', 'atr_14')} FROM p",
        "binary_metrics": f"WITH c AS (SELECT round_id, {counts} FROM ({PRED}) GROUP BY 1), a AS ({_auc('actual', 'proba', PRED)}) SELECT round_id, {_r('tp / (tp + fn)', 'recall')}, {_r('tp / (tp + fp)', 'precision')}, {_r('fp / (fp + tn)', 'fpr')}, {_r('(tp + tn) / n', 'accuracy')}, {_r('auc', 'auc')} FROM c JOIN a USING (round_id)",
        "multiclass_metrics": f"WITH p AS ({cls}), c AS (SELECT DISTINCT round_id, x FROM (SELECT round_id, actual AS x FROM p UNION ALL SELECT round_id, prediction FROM p)), m AS (SELECT c.round_id, x, count(*) FILTER (actual = x) AS a, count(*) FILTER (prediction = x) AS p, count(*) FILTER (actual = x AND prediction = x) AS ok FROM c JOIN p USING (round_id) GROUP BY 1, 2) SELECT round_id, {_r('avg(CASE WHEN p = 0 THEN 0 ELSE ok / p END)', 'precision')}, {_r('avg(CASE WHEN a = 0 THEN 0 ELSE ok / a END)', 'recall')}, {_r('sum(ok) / sum(a)', 'accuracy')} FROM m GROUP BY 1",
        "ovr_auc": f"WITH p AS ({cls}), a AS (" + " UNION ALL ".join(_auc(f"(actual = {c})::INT", s, "SELECT * FROM p") for c, s in ((0, "open"), (1, "close"), (2, "volume"))) + f") SELECT round_id, {_r('avg(auc)', 'auc')} FROM a GROUP BY 1",
        "continuous_metrics": f"WITH p AS (SELECT *, close - target AS e FROM ({PRED})) SELECT round_id, {_r('avg(e)', 'bias')}, {_r('avg(abs(e))', 'mae')}, {_r('sqrt(avg(e * e))', 'rmse')}, {_r('1 - sum(e * e) / (var_pop(target) * count(*))', 'r2')}, {_r('avg(abs(e) / abs(target)) * 100', 'mape')} FROM p GROUP BY 1",
        "balanced_metric": f"SELECT round_id, {_r('tp / (tp + fp) * sqrt((tp + fp) / n)', 'balanced')} FROM (SELECT round_id, {counts} FROM ({PRED}) GROUP BY 1)",
        "threshold_sweep": _threshold(), "threshold_f1": _threshold("2 * tp / (pp + yes)", "f1"), "threshold_default": _threshold(proba="proba / 10"),
        "confusion_metrics": CONFUSION, "backtest_snapshot": SNAPSHOT,
        "rank_correlation": f"WITH r AS (SELECT round_id, rank() OVER (PARTITION BY round_id ORDER BY close) + (count(*) OVER (PARTITION BY round_id, close) - 1) / 2.0 AS a, rank() OVER (PARTITION BY round_id ORDER BY volume) + (count(*) OVER (PARTITION BY round_id, volume) - 1) / 2.0 AS b FROM ({PRED})) SELECT round_id, {_r('corr(a, b)', 'correlation')} FROM r GROUP BY 1",
        "confidence_filter": f"WITH m AS (SELECT round_id, datetime, hour(datetime) % 2 = 0 AS val, target, avg(close * (1 + 0.01 * i) + i * maker_ratio) AS p, stddev_pop(close * (1 + 0.01 * i) + i * maker_ratio) AS u FROM ({PRED}), range(3) r(i) GROUP BY ALL), t AS (SELECT quantile_cont(u, 0.8) AS t FROM m WHERE val) SELECT round_id, datetime, u <= t AS is_confident, {_r('p', 'prediction')}, {_r('u', 'uncertainty')}, {_r('t', 'confidence_threshold')}, {_r('target', 'actual_value')}, {_r('1 / (1 + u)', 'confidence_score')} FROM m, t WHERE NOT val",
        "aggregate_predictions": f"WITH p AS ({PRED}) SELECT 'mean' AS how, datetime, {_r('avg(prediction)', 'prediction')} FROM p GROUP BY 2 UNION ALL SELECT 'median', datetime, {_r('median(prediction)', 'prediction')} FROM p GROUP BY 2 UNION ALL SELECT 'majority', datetime, arg_max(prediction, (n, f))::DOUBLE FROM (SELECT datetime, prediction, count(*) AS n, max(-substr(round_id, 2, 1)::INT) AS f FROM p GROUP BY 1, 2) GROUP BY 2",
        "iqr_filter": _iqr(K, ["volume", "std"], 0.5), "iqr_filter_constant": _iqr(f"SELECT *, (close > 450)::INT AS flat FROM ({K})", ["flat", "std"], 3.0), "calibrate": CALIBRATED, "split_random": SPLIT_RANDOM, "manifest_prepared": PREPARED, "flagship": _flagship(),
        "manifest_graph": _graph(), "long_rolling": LONG_ROLLING, "long_running": LONG_RUNNING, "long_ewm": LONG_EWM,
        "asof_backward": _asof("backward"), "asof_forward": _asof("forward"), "asof_nearest": _asof("nearest"), "interval_join": INTERVALS,
        "sequential_backtest": SEQUENTIAL, "sql_backtest": SEQUENTIAL, "sql_bars": _bars("volume", 2000), "windows_sliding": SLIDING, "windows_session": SESSIONS,
    }
    return out



