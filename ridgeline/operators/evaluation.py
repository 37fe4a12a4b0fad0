"""Metrics, confusion statistics, backtests and confidence filtering, grouped by round (and whatever else keys name)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.columns import clip, fdiv

C = F.col
K = ("round_id",)
#: A log is broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20


def _div(a: Column, b: Column) -> Column:
    """Null if the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def auc(df: DataFrame, label: str | Column, score: str, keys: Sequence[str] = K, name: str = "auc") -> DataFrame:
    """Area under the ROC curve by average ranks: exact, ties included.

    Distinct scores are counted before they are ranked, so a window holds one row
    per score; null without both classes.
    """
    y = C(label) if isinstance(label, str) else label
    by_score = df.groupBy(*keys, score).agg(_count(y == 1).alias("p"), _count(y != 1).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by_score.withColumn("w", C("p") * (below + C("n") / 2))
    return wins.groupBy(*keys).agg(_div(F.sum("w"), F.sum("p") * F.sum("n")).alias(name))


def binary_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction", proba: str = "proba", keys: Sequence[str] = K) -> DataFrame:
    """recall, precision, fpr, accuracy, auc."""
    y, p = C(actual) == 1, C(prediction) == 1
    tp, fp, fn, tn = (F.count(F.when(a & b, 1)) for a, b in ((y, p), (~y, p), (y, ~p), (~y, ~p)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.groupBy(*keys).agg(zero(_div(tp, tp + fn)).alias("recall"), zero(_div(tp, tp + fp)).alias("precision"), zero(_div(fp, fp + tn)).alias("fpr"), _div(tp + tn, F.count("*")).alias("accuracy"))
    return out.join(auc(df, actual, proba, keys), list(keys))


def multiclass_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction", keys: Sequence[str] = K) -> DataFrame:
    """Macro precision and recall over the classes that occur as actual or prediction, and accuracy."""
    ok = (C(actual) == C(prediction)).cast("int")
    pairs = df.select(*keys, F.explode(F.array(F.struct(C(actual).alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p"), ok.alias("ok")), F.struct(C(prediction).alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("ok")))).alias("x")).select(*keys, "x.*")
    by_class = pairs.groupBy(*keys, "c").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("ok").alias("ok"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return by_class.groupBy(*keys).agg(F.avg(zero(_div(C("ok"), C("p")))).alias("precision"), F.avg(zero(_div(C("ok"), C("a")))).alias("recall"), _div(F.sum("ok"), F.sum("a")).alias("accuracy"))


def ovr_auc(df: DataFrame, actual: str, scores: dict[object, str], keys: Sequence[str] = K) -> DataFrame:
    """Mean one-versus-rest AUC over the classes present. scores: class -> its score column (by label, not by place)."""
    long = df.select(*keys, C(actual).alias("y"), F.explode(F.array(*(F.struct(F.lit(str(c)).alias("c"), C(s).cast("double").alias("s")) for c, s in scores.items()))).alias("x")).select(*keys, "y", "x.*")
    each = auc(long, (C("y").cast("string") == C("c")).cast("int"), "s", [*keys, "c"])
    return each.groupBy(*keys).agg(F.avg("auc").alias("auc"))


def continuous_metrics(df: DataFrame, actual: str = "actual", prediction: str = "prediction", keys: Sequence[str] = K) -> DataFrame:
    """bias, mae, rmse, r2, mape (percent)."""
    e, y = C(prediction) - C(actual), C(actual)
    return df.groupBy(*keys).agg(
        F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - _div(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))) * 100).alias("mape"),
    )


def balanced_metric(df: DataFrame, actual: str = "actual", prediction: str = "prediction", keys: Sequence[str] = K) -> DataFrame:
    """Precision times the root of the share of positive predictions; 0 without any."""
    p = C(prediction) == 1
    tp, pp = F.count(F.when(p & (C(actual) == 1), 1)), F.count(F.when(p, 1))
    return df.groupBy(*keys).agg(F.coalesce(_div(tp, pp) * F.sqrt(_div(pp, F.count("*"))), F.lit(0.0)).alias("balanced"))


def optimize_threshold(df: DataFrame, actual: str = "actual", proba: str = "proba", keys: Sequence[str] = K, low: float = 0.20, high: float = 0.70, step: float = 0.05, metric: str = "balanced", default: float = 0.35) -> DataFrame:
    """threshold and score (named after the metric: balanced, f1, precision or accuracy; other names mean balanced).

    Of equal scores the first threshold; thresholds without positives are skipped, and a group
    without any gets the default and the score -1.
    """
    import numpy as np

    metric = metric if metric in ("f1", "precision", "accuracy") else "balanced"
    tried = [float(t) for t in np.arange(low, high + step, step)]
    swept = df.select(*keys, C(actual).alias("y"), C(proba).alias("s"), F.explode(F.array(*map(F.lit, tried))).alias("threshold"))
    p = C("s") >= C("threshold")
    tp, pp, n, yes = F.count(F.when(p & (C("y") == 1), 1)), F.count(F.when(p, 1)), F.count("*"), F.count(F.when(C("y") == 1, 1))
    score = {"balanced": _div(tp, pp) * F.sqrt(_div(pp, n)), "precision": _div(tp, pp), "f1": _div(2 * tp, pp + yes), "accuracy": _div(n - pp - yes + 2 * tp, n)}[metric]
    scored = swept.groupBy(*keys, "threshold").agg(F.when(pp > 0, score).alias("__score"))
    best = F.max_by(F.struct("threshold", "__score"), F.when(C("__score").isNotNull(), F.struct("__score", -C("threshold"))))
    found = scored.groupBy(*keys).agg(best.alias("b"))
    return found.select(*keys, F.coalesce("b.threshold", F.lit(default)).alias("threshold"), F.coalesce("b.__score", F.lit(-1.0)).alias(metric))


def confusion_metrics(df: DataFrame, x: str, actual: str = "actual", prediction: str = "prediction", keys: Sequence[str] = K, quantiles: tuple[float, float] = (0.01, 0.99), outliers: str = "filter", proba: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, rates and the distribution of x in the cells of the confusion matrix, Cohen's d and KS of TP against FP; x_name says which column x is.

    proba: a column of probabilities that, cut at the threshold, stand for the prediction.
    """
    if proba is not None:
        df, prediction = df.withColumn("__cut", (C(proba) >= threshold).cast("int")), "__cut"
    if outliers not in ("filter", "winsor"):
        raise ValueError("outliers must be filter or winsor")
    keys = list(keys)
    bounds = df.groupBy(*keys).agg(F.percentile(x, quantiles[0]).alias("__lo"), F.percentile(x, quantiles[1]).alias("__hi"))
    rows = df.join(bounds, keys).withColumns({"x": C(x).cast("double"), "y": C(actual).cast("int"), "p": C(prediction).cast("int")})
    rows = rows.where((C("x") >= C("__lo")) & (C("x") <= C("__hi"))) if outliers == "filter" else rows.withColumn("x", clip(C("x"), C("__lo"), C("__hi")))
    rows = rows.select(*keys, "x", "y", "p")
    pp = C("p") == 1
    tp, fp, fn = pp & (C("y") == 1), pp & (C("y") == 0), (C("p") == 0) & (C("y") == 1)
    of = lambda f, m: f(F.when(m, C("x")))
    n_tp, n_fp, n_fn, n = _count(tp), _count(fp), _count(fn), F.count("*")
    pooled = F.sqrt(_div((n_tp - 1) * of(F.var_samp, tp) + (n_fp - 1) * of(F.var_samp, fp), n_tp + n_fp - 2))
    out = rows.groupBy(*keys).agg(
        (_div(n_tp + n_fp, n) * 100).alias("pred_pos_rate_pct"), (_div(n_tp + n_fn, n) * 100).alias("actual_pos_rate_pct"), (_div(n_tp, n_tp + n_fp) * 100).alias("precision_pct"),
        (_div(n_tp, n_tp + n_fn) * 100).alias("recall_pct"), of(F.avg, tp).alias("tp_x_mean"), of(F.avg, fp).alias("fp_x_mean"), of(F.median, tp).alias("tp_x_median"), of(F.median, fp).alias("fp_x_median"),
        (n_tp + n_fp).alias("pred_pos_count"), of(F.avg, pp).alias("pred_pos_x_mean"), of(F.median, pp).alias("pred_pos_x_median"), n_tp.alias("tp_count"), n_fp.alias("fp_count"),
        _div(of(F.avg, tp) - of(F.avg, fp), pooled).alias("tp_fp_cohen_d"), n.alias("n_kept"),
    )
    values = rows.where(pp & C("y").isin(0, 1)).groupBy(*keys, "x").agg(_count(C("y") == 1).alias("a"), _count(C("y") == 0).alias("b"))
    w, whole = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(_div(F.sum("a").over(w), F.sum("a").over(whole)) - _div(F.sum("b").over(w), F.sum("b").over(whole)))
    ks = values.withColumn("g", gap).groupBy(*keys).agg(F.max("g").alias("tp_fp_ks"))
    return out.join(ks, keys, "left").withColumn("x_name", F.lit(x))


def backtest_snapshot(df: DataFrame, prediction: str = "prediction", keys: Sequence[str] = K, order: str = "datetime", fee_bps: float = 5.0, slip_bps: float = 5.0, count_runs: bool = False) -> DataFrame:
    """Long while the prediction is 1: first bar close against open, later bars close against close, costs at the end of a run."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = (F.coalesce(C(prediction).cast("int"), F.lit(0)) >= 1) & C("open").isNotNull() & C("close").isNotNull() & C("price_change").isNotNull() & (C("open") != 0)
    df = df.withColumn("__in", F.coalesce(ok, F.lit(False)))
    df = df.withColumns({"__before": F.coalesce(F.lag("__in").over(w), F.lit(False)), "__after": F.coalesce(F.lead("__in").over(w), F.lit(False)), "__c1": F.lag("close").over(w)})
    gross = F.when(C("__in") & ~C("__before"), fdiv("price_change", "open")).when(C("__in"), fdiv("close", "__c1") - 1).otherwise(0.0)
    cost = 2.0 * (fee_bps + slip_bps) / 10_000.0
    df = df.withColumn("__g", F.coalesce(gross, F.lit(0.0)))
    df = df.withColumn("__r", C("__g") - F.when(C("__in") & ~C("__after"), cost).otherwise(0.0))
    df = df.withColumns({"__eg": F.product(C("__g") + 1).over(so_far), "__en": F.product(C("__r") + 1).over(so_far)})
    df = df.withColumn("__dd", C("__en") / F.max("__en").over(so_far) - 1)
    held = F.when(C("__in"), C("__r"))
    return df.groupBy(*keys).agg(
        (_div(_count(held > 0), _count(C("__in"))) * 100).alias("trade_win_rate_pct"), (F.avg(held) * 100).alias("trade_expectancy_pct"), (F.min("__dd") * 100).alias("max_drawdown_pct"),
        ((F.max_by("__eg", order) - 1) * 100).alias("total_return_gross_pct"), ((F.max_by("__en", order) - 1) * 100).alias("total_return_net_pct"),
        (F.avg(F.when(held > 0, held)) * 100).alias("trade_return_mean_win_pct"), (F.avg(F.when(held < 0, held)) * 100).alias("trade_return_mean_loss_pct"), F.count("*").alias("bars_total"),
        _div(F.avg("__r"), F.stddev_samp("__r")).alias("sharpe_per_bar"), (_div(_count(C("__in")), F.count("*")) * 100).alias("bars_in_market_pct"),
        _count(C("__in") & ~C("__before") if count_runs else C("__in")).alias("trades_count"), F.lit(2 * (fee_bps + slip_bps)).alias("cost_round_trip_bps"),
    )


def confidence_filter(df: DataFrame, row: Sequence[str], target_confidence: float = 0.8) -> DataFrame:
    """Predictions of several models per row (long form: split, row..., model, prediction, actual).

    Mean and population deviation over the models; the threshold is the validation
    split's percentile of deviations; the test split's rows are scored against it.
    """
    by_row = df.groupBy("split", *row).agg(F.avg("prediction").alias("prediction"), F.stddev_pop("prediction").alias("uncertainty"), F.first("actual").alias("actual_value"))
    threshold = by_row.where(C("split") == "val").agg(F.percentile("uncertainty", target_confidence).alias("confidence_threshold"))
    out = by_row.where(C("split") == "test").join(F.broadcast(threshold))  # one row
    return out.select(*row, "prediction", "uncertainty", (C("uncertainty") <= C("confidence_threshold")).alias("is_confident"), "confidence_threshold", "actual_value", (1 / (1 + C("uncertainty"))).alias("confidence_score"))


def inversions(ranks) -> int:
    """Pairs of a later and a smaller rank, in n log n: each pair counts at the highest bit in which its ranks differ."""
    import numpy as np

    ranks, count = np.asarray(ranks, np.int64), 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        ranks = ranks[np.argsort(ranks >> (bit + 1), kind="stable")]  # ranks that agree in the higher bits stand together, in their order
        ones = (ranks >> bit) & 1
        before = np.cumsum(ones) - ones
        group = ranks >> (bit + 1)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = before - np.repeat(before[begin], np.diff(np.append(begin, len(ranks))))
        count += int(own[ones == 0].sum())
    return count


def kendall_pairs(x, y) -> tuple[int, int, int]:
    """Concordant less discordant pairs, pairs that differ in x, and pairs that differ in y."""
    import numpy as np

    n = len(x)
    if n < 2:
        return 0, 0, 0
    (x, y), pairs = (np.unique(v, return_inverse=True)[1] for v in (x, y)), lambda v: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(v, return_counts=True)[1])
    order = np.lexsort((y, x))
    tied_x, tied_y, tied_both, every = pairs(x), pairs(y), pairs(x * (int(y.max()) + 1) + y), n * (n - 1) // 2
    return every - tied_x - tied_y + tied_both - 2 * inversions(y[order]), every - tied_x, every - tied_y


def rank_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str] = K, method: str = "spearman") -> DataFrame:
    """Pearson, Spearman (average ranks) or Kendall (tau-b) correlation; null for constants."""
    keys = list(keys)
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method: {method}")
    if method == "kendall":
        schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("correlation", T.DoubleType())])

        def tau(key, pdf):
            import numpy as np
            import pandas as pd

            x, y = (pdf[c].to_numpy(float) for c in ("__a", "__b"))
            known = ~(np.isnan(x) | np.isnan(y))
            x, y = x[known], y[known]
            both, only_x, only_y = kendall_pairs(x, y)
            return pd.DataFrame([[*key, both / np.sqrt(only_x) / np.sqrt(only_y) if only_x and only_y else None]], columns=schema.names).astype({"correlation": float})

        return df.select(*keys, C(a).cast("double").alias("__a"), C(b).cast("double").alias("__b")).groupBy(*keys).applyInPandas(tau, schema).withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))
    if method == "spearman":
        rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
        df = df.where(C(a).isNotNull() & C(b).isNotNull()).withColumns({"__a": rank(a), "__b": rank(b)})
    else:
        df = df.withColumns({"__a": C(a).cast("double"), "__b": C(b).cast("double")})
    return df.groupBy(*keys).agg(_div(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("correlation"))


def parameter_correlation(log: DataFrame, metric: str, params: Sequence[str], heads: Sequence[float] = (0.99, 0.5, 0.1), n_boot: int = 300, method: str = "spearman", seed: int = 0) -> DataFrame:
    """Correlation of each parameter with the metric in the best shares of rounds, with a bootstrap's median, interval and sign stability.

    Each draw is a seeded hash of its bootstrap and number, made on the executors: n draws with replacement from the share's n rounds.
    The log has a row per round; it is broadcast if it is small by its bytes.
    """
    n = log.count()
    ranked = log.select(C(metric).cast("double").alias("m"), *(C(p).try_cast("double").alias(p) for p in params)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit("log")).orderBy(C("m").desc(), *params)) - 1)
    sizes = F.array(*(F.struct(F.lit(float(h)).alias("head"), F.lit(max(1, int(n * h))).alias("size")) for h in heads))
    plan = log.sparkSession.range(-1, n_boot, 1, 8).select(C("id").cast("int").alias("boot"), F.explode(sizes).alias("h")).select("boot", "h.*").select("*", F.explode(F.sequence(F.lit(0), C("size") - 1)).alias("j"))
    drawn = F.when(C("boot") < 0, C("j")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "head", "boot", "j"), C("size")))
    plan = plan.select("head", "boot", drawn.cast("int").alias("r"))
    long = plan.join(F.broadcast(ranked) if n * 16 * (len(params) + 2) <= BROADCAST_BYTES else ranked, "r")
    long = long.select("head", "boot", "m", F.explode(F.array(*(F.struct(F.lit(p).alias("param"), C(p).alias("v")) for p in params))).alias("x")).select("head", "boot", "m", "x.*")
    each = rank_correlation(long, "m", "v", ["head", "param", "boot"], method)
    c, boot = C("correlation"), C("boot") >= 0
    return each.groupBy("head", "param").agg(
        F.max(F.when(~boot, c)).alias("correlation"), F.median(F.when(boot, c)).alias("boot_median"), F.percentile(F.when(boot, c), 0.025).alias("ci_low"), F.percentile(F.when(boot, c), 0.975).alias("ci_high"),
        F.greatest(_div(_count(boot & (c > 0)), _count(boot & c.isNotNull())), _div(_count(boot & (c < 0)), _count(boot & c.isNotNull()))).alias("sign_stability"),
    )


def prediction_performance(predictions: DataFrame, bars: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Predictions with their bars' prices and hit or miss, joined by time."""
    joined = predictions.join(bars.select(*keys, "datetime", "open", "close", (C("close") - C("open")).alias("price_change")), [*keys, "datetime"])
    hit = C("prediction") == C("actual")
    return joined.withColumns({"hit": hit, "miss": ~hit})


def sequential_backtest(df: DataFrame, keys: Sequence[str] = K, order: str = "datetime", start_usdt: float = 30_000.0, fee_rate: float = 0.001) -> DataFrame:
    """Round trips bar by bar with an account: state with rounding, so one ordered scan per key."""
    from ridgeline.operators.ledger import run_backtest

    names = ("pnl", "win_rate", "max_drawdown", "expected_value", "sharpe_ratio", "net_long_volume", "net_short_volume", "net_trade_volume")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def scan(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        got = run_backtest(pdf["prediction"].tolist(), pdf["open"].tolist(), pdf["close"].tolist(), start_usdt, fee_rate)
        return pd.DataFrame([[*key, *(float(got[n]) for n in names)]], columns=schema.names)

    return df.select(*keys, order, "prediction", "open", "close").groupBy(*keys).applyInPandas(scan, schema)
