"""Splits, sampling, fitted transforms and scalers. All fitting reads the training split only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import clip, fdiv

C = F.col
SPLITS = ("train", "val", "test")


def row_index(df: DataFrame, keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",), name: str = "i") -> DataFrame:
    """Row numbers from 0 within each series."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _split_by(df: DataFrame, position: Column, ratios: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Sizes are floor(n * ratio / sum); the last split takes the rest."""
    total = sum(ratios)
    df = df.withColumns({"__p": position, "__n": F.count("*").over(Window.partitionBy(*keys))})
    bound, split = F.lit(0), None
    for name, ratio in list(zip(SPLITS, ratios, strict=False))[:-1]:
        bound = bound + F.floor(C("__n") * ratio / total)
        split = F.when(C("__p") < bound, name) if split is None else split.when(C("__p") < bound, name)
    last = SPLITS[len(ratios) - 1]
    return df.withColumn("split", F.lit(last) if split is None else split.otherwise(last)).drop("__p", "__n")


def split_sequential(df: DataFrame, ratios: Sequence[float] = (8, 1, 2), keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    """Add split: train, val, test in order of time."""
    return _split_by(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, ratios, keys)


def split_random(df: DataFrame, ratios: Sequence[float] = (8, 1, 2), seed: int = 0, keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    """Like split_sequential in a random order that the seed repeats; always disjoint."""
    shuffled = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(C(c).cast("string") for c in order)).cast("binary")), *order)
    return _split_by(df, F.row_number().over(shuffled) - 1, ratios, keys)


def random_slice(df: DataFrame, rows: int, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0, index: str = "i") -> DataFrame:
    """`rows` consecutive rows of n; the start is drawn from [n * low, n * high - rows]."""
    import numpy as np

    if not 0 <= low < high <= 1:
        raise ValueError("need 0 <= low < high <= 1")
    first, last = int(n * low), int(n * high) - rows
    if rows <= 0 or last < first:
        raise ValueError("the slice doesn't fit")
    start = int(np.random.default_rng(seed).integers(first, last + 1))
    return df.where((C(index) >= start) & (C(index) < start + rows))


def missing_datetimes(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Times that preparation lost."""
    return before.select(*keys, "datetime").distinct().join(after.select(*keys, "datetime"), [*keys, "datetime"], "left_anti")


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """{name: (column, q)}: one row per key with the sorted values at index round((n - 1) * q), half away from zero.

    All columns are ranked together, each (key, column) by a sort that spills: no group is gathered in a list.
    """
    cols = sorted({c for c, _ in wanted.values()})
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("__c"), C(c).cast("double").alias("__v")) for c in cols))).alias("__x")).select(*keys, "__x.*").where("__v IS NOT NULL")
    w = Window.partitionBy(*keys, "__c")
    ranked = long.withColumns({"__n": F.count("*").over(w), "__k": F.row_number().over(w.orderBy("__v")) - 1})
    return ranked.groupBy(*keys).agg(*(F.max(F.when((C("__c") == c) & (C("__k") == F.floor((C("__n") - 1) * q + 0.5)), C("__v"))).alias(name) for name, (c, q) in wanted.items()))


def target_quantile_flags(df: DataFrame, targets: dict[str, tuple[str, float]], shift: int = 0, keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    """{name: (column, q)}: 1 above the training split's (1 - q) quantile ('nearest'), then shifted within the split (-1: from the next row).

    All cut-offs come from one ranking, however many targets there are.
    """
    df = df.join(quantiles(df.where(C("split") == "train"), keys, {f"__cut_{n}": (c, 1.0 - q) for n, (c, q) in targets.items()}), list(keys), "left")
    df = df.withColumns({n: (C(c) > C(f"__cut_{n}")).cast("int") for n, (c, _) in targets.items()}).drop(*(f"__cut_{n}" for n in targets))
    if shift:
        w = Window.partitionBy(*keys, "split").orderBy(*order)
        df = df.withColumns({n: F.lead(n, -shift).over(w) if shift < 0 else F.lag(n, shift).over(w) for n in targets})
    return df


def target_quantile_flag(df: DataFrame, col: str, q: float, shift: int = 0, keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    return target_quantile_flags(df, {"quantile_flag": (col, q)}, shift, keys, order)


def shift_column(df: DataFrame, column: str, shift: int, keys: Sequence[str] = ("series",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(column, F.lag(column, shift).over(w) if shift >= 0 else F.lead(column, -shift).over(w))


def _numbers(df: DataFrame, columns: Sequence[str] | None, keys: Sequence[str]) -> list[str]:
    numeric = re.compile(r"(tiny|small|big)?int|float|double|decimal|long|bigint")
    return list(columns) if columns else [c for c, t in df.dtypes if numeric.match(t) and c not in keys]


def _order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Untouched columns first, then the transformed ones."""
    return df.select(*(c for c in df.columns if c not in columns), *columns)


def _fitted(df: DataFrame, columns: Sequence[str], keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    fitted = df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return df.join(fitted, list(keys), "left")


def zscore(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ("series",)) -> DataFrame:
    """(x - mean) / sample deviation; a deviation of 0 counts as 1."""
    columns = _numbers(df, columns, keys)
    fit = _fitted(df, columns, keys, {f"__{m}_{c}": f(c) for c in columns for m, f in (("m", F.avg), ("s", F.stddev_samp))})
    scaled = {c: fdiv(C(c) - C(f"__m_{c}"), F.when(C(f"__s_{c}") == 0, 1.0).otherwise(C(f"__s_{c}"))) for c in columns}
    return _order(fit.withColumns(scaled).select(*df.columns), columns)


def mad(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ("series",)) -> DataFrame:
    """(x - median) / median absolute deviation; 0 counts as 1."""
    columns = _numbers(df, columns, keys)
    fit = _fitted(df, columns, keys, {f"__m_{c}": F.median(c) for c in columns})
    fit = _fitted(fit, columns, keys, {f"__d_{c}": F.median(F.abs(C(c) - C(f"__m_{c}"))) for c in columns})
    scaled = {c: fdiv(C(c) - C(f"__m_{c}"), F.when(C(f"__d_{c}") == 0, 1.0).otherwise(C(f"__d_{c}"))) for c in columns}
    return _order(fit.withColumns(scaled).select(*df.columns), columns)


def winsorize(df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.01, high: float = 0.99, keys: Sequence[str] = ("series",)) -> DataFrame:
    columns = _numbers(df, columns, keys)
    fit = df.join(quantiles(df, keys, {f"__{m}_{c}": (c, q) for c in columns for m, q in (("l", low), ("h", high))}), list(keys), "left")
    return _order(fit.withColumns({c: clip(C(c), C(f"__l_{c}"), C(f"__h_{c}")) for c in columns}).select(*df.columns), columns)


def quantile_trim(df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.005, high: float = 0.995, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Keep rows whose numbers all lie within their quantiles or are null."""
    columns = _numbers(df, columns, keys)
    fit = df.join(quantiles(df, keys, {f"__{m}_{c}": (c, q) for c in columns for m, q in (("l", low), ("h", high))}), list(keys), "left")
    for c in columns:
        fit = fit.where(C(c).isNull() | ((C(c) >= C(f"__l_{c}")) & (C(c) <= C(f"__h_{c}"))))
    return _order(fit.select(*df.columns), columns)


#: Scaling by column name, in this order; the first pattern that matches decides.
LINEAR_RULES = tuple(
    (f"^{name}$", rule)
    for name, rule in (
        ("open", "standard"), ("close", "standard"), ("high", "standard"), ("low", "standard"), ("mean", "standard"), ("median", "standard"), ("std", "standard"), ("iqr", "standard"),
        ("maker_ratio", "none"), ("volume", "log_standard"), ("no_of_trades", "log_standard"),
        ("open_liquidity", "log_standard"), ("high_liquidity", "log_standard"), ("low_liquidity", "log_standard"), ("close_liquidity", "log_standard"), ("liquidity_sum", "log_standard"),
        ("maker_volume", "standard"), ("maker_liquidity", "standard"), (r"roc(_\d+)?", "standard"), (r"atr(_\d+)?", "standard"), ("(sma|short_sma|medium_sma|long_sma)", "standard"),
        ("macd", "standard"), (r"ppo(_\d+_\d+)?", "standard"), (r"ppo_signal(_\d+)?", "standard"), (r"wilder_rsi(_\d+)?", "standard"), ("vwap", "standard"), ("imbalance", "standard"),
        ("body_pct", "standard"), ("returns", "standard"), (r"atr_percent_sma(_\d+)?", "standard"), ("close_position", "standard"), (r"close_volatility(_\d+)?", "standard"),
        ("trend_strength", "standard"), ("volume_regime", "standard"), (r"distance_from_high(_\d+)?", "log_standard"), (r"distance_from_low(_\d+)?", "log_standard"),
        ("breakout_ema", "standard"), ("gap_high", "standard"), (r"tenkan(_\d+)?", "standard"), (r"kijun(_\d+)?", "standard"), (r"senkou_a(_\d+)?", "standard"), (r"senkou_b(_\d+)?", "standard"),
        (r"chikou(_\d+)?", "standard"), (r"price_range_position(_\d+)?", "standard"), ("range_pct", "standard"), (".*", "none"),
    )
)
#: Scaling by exact column name for logistic regression.
LOGREG_NAMES = {
    "open": "standard", "close": "standard", "high": "standard", "low": "standard", "volume": "log_standard", "maker_ratio": "none", "no_of_trades": "log_standard",
    "atr": "standard", "ema_breakout": "standard", "imbalance": "standard", "macd": "standard", "ppo": "standard", "roc": "standard", "vwap": "standard", "wilder_rsi": "divide_100",
    "returns": "standard", "range_pct": "standard", "close_position": "standard", "body_pct": "standard", "gap_high": "standard",
    "open_liquidity": "log_standard", "high_liquidity": "log_standard", "low_liquidity": "log_standard", "close_liquidity": "log_standard",
}


def build_rules(overrides: dict[str, str], rules: Sequence[tuple[str, str]] = LINEAR_RULES) -> tuple[tuple[str, str], ...]:
    """Overrides take precedence."""
    return (*overrides.items(), *rules)


def exact_rules(names: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """Rules by exact column name; other columns pass."""
    return (*((f"^{re.escape(n)}$", r) for n, r in names.items()), (r".*", "none"))


class Scaler:
    """Standard, log-standard, divide-by-100 or no scaling, fitted on the training split; deviations are population ones."""

    def __init__(self, columns: Sequence[str], rules: Sequence[tuple[str, str]] = LINEAR_RULES, keys: Sequence[str] = ("series",)):
        self.keys = tuple(keys)
        self.rule = {c: next(r for p, r in rules if re.match(p, c)) for c in columns}

    def _base(self, c: str) -> Column:
        return F.log1p(C(c)) if self.rule[c] == "log_standard" else C(c)

    def fit(self, df: DataFrame) -> DataFrame:
        """One row per key: the means and deviations."""
        cols = [c for c, r in self.rule.items() if "standard" in r]
        train = df.where(C("split") == "train").groupBy(*self.keys)
        return train.agg(*(f(self._base(c)).alias(f"__{m}_{c}") for c in cols for m, f in (("m", F.avg), ("s", F.stddev_pop))), F.count("*").alias("__fit_rows"))

    def _sd(self, c: str) -> Column:
        return F.when(C(f"__s_{c}") == 0, 1.0).otherwise(C(f"__s_{c}"))

    def transform(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        new = {c: fdiv(self._base(c) - C(f"__m_{c}"), self._sd(c)) if "standard" in r else C(c) / 100.0 for c, r in self.rule.items() if r != "none"}
        return df.join(fitted, list(self.keys), "left").withColumns(new).select(*df.columns)

    def inverse(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        new = {}
        for c, r in self.rule.items():
            back = C(c) * self._sd(c) + C(f"__m_{c}") if "standard" in r else C(c) * 100.0
            if r != "none":
                new[c] = F.expm1(back) if r == "log_standard" else back
        return df.join(fitted, list(self.keys), "left").withColumns(new).select(*df.columns)
