"""Regime pools: filter a log of models, cluster it into regimes, choose diverse models in each, combine their predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import drop_null_rows

C = F.col


def iqr_filter(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """Drop rows without performance; then outliers column after column, each on what the one before left.

    A column whose quartiles are equal filters nothing. The quartiles are the sorted values at index
    round((n - 1) * q), counted with partial sums.
    """
    df = drop_null_rows(df, list(columns))
    for c in columns:
        n = df.where(C(c).isNotNull()).count()
        if not n:
            continue
        at = [(math.floor((n - 1) * q + 0.5) + 0.5) / n for q in (0.25, 0.75)]
        low, high = df.agg(*(F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY `{c}`)") for q in at)).first()
        if low == high:
            continue
        reach = factor * (high - low)
        df = df.where((C(c) >= low - reach) & (C(c) <= high + reach))
    return df


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    raw = VectorAssembler(inputCols=list(columns), outputCol="__raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(raw).transform(raw).drop("__raw")


def cluster(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42, name: str = "regime") -> DataFrame:
    """Add the regime, 0 for all if k is 1."""
    from pyspark.ml.clustering import KMeans

    n = min(k, df.count())
    if n <= 1:
        return df.withColumn(name, F.lit(0))
    return KMeans(k=n, seed=seed, featuresCol="__x", predictionCol=name).fit(x := _scaled(df, columns)).transform(x).drop("__x")


def diverse_selection(df: DataFrame, columns: Sequence[str], n_models: int, id_col: str = "round_id", n_pca: int = 2, seed: int = 42) -> DataFrame:
    """The medoid of each of n_models clusters in PCA space; what is missing is filled by the best mean min-max score."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    n = df.count()
    if n <= n_models:
        return df
    x = _scaled(df, columns)
    x = PCA(k=min(n_pca, len(columns)), inputCol="__x", outputCol="__p").fit(x).transform(x)
    model = KMeans(k=n_models, seed=seed, featuresCol="__p", predictionCol="__c").fit(x)
    centers = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.clusterCenters()))
    gap = F.aggregate(F.zip_with(vector_to_array("__p"), F.element_at(centers, C("__c") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    x = model.transform(x).withColumn("__d", gap)
    x = x.withColumn("__first", F.row_number().over(Window.partitionBy("__c").orderBy("__d", id_col)) == 1)
    low, high = (x.agg(*(f(c).alias(c) for c in columns)).first() for f in (F.min, F.max))
    score = sum(((C(c) - low[c]) / ((high[c] - low[c]) or 1.0) for c in columns), F.lit(0.0)) / len(columns)
    return x.withColumn("__s", score).orderBy(C("__first").desc(), C("__s").desc(), id_col).limit(n_models).select(*df.columns)


def offline_pools(log: DataFrame, columns: Sequence[str], n_regimes: int = 3, n_models: int = 5, id_col: str = "round_id", seed: int = 42) -> DataFrame:
    """The chosen models with their regime."""
    kept = iqr_filter(log, columns)
    kept = cluster(kept if kept.limit(1).count() else log, columns, n_regimes, seed)
    out = None
    for r in range(n_regimes):
        part = diverse_selection(kept.where(C("regime") == r), columns, n_models, id_col, seed=seed)
        out = part if out is None else out.unionByName(part)
    return out


def aggregate_predictions(df: DataFrame, how: str = "mean", keys: Sequence[str] = ("datetime",), threshold: float | None = None, order: str = "round_id") -> DataFrame:
    """Combine the models' predictions per key: mean (also for unknown names), median, or majority (of equal votes the first seen)."""
    if how == "majority":
        votes = df.groupBy(*keys, "prediction").agg(F.count("*").alias("n"), F.min(order).alias("first"))
        out = votes.groupBy(*keys).agg(F.max_by("prediction", F.struct("n", -C("first"))).cast("double").alias("prediction"))
    else:
        out = df.groupBy(*keys).agg((F.median if how == "median" else F.avg)("prediction").alias("prediction"))
    return out if threshold is None else out.withColumn("prediction", (C("prediction") >= threshold).cast("int"))


def online_pools(predictions: DataFrame, pools: DataFrame, how: str = "mean", keys: Sequence[str] = ("datetime",), threshold: float | None = None) -> DataFrame:
    """One column regime_{id}_prediction per pool; predictions are matched by time."""
    joined = predictions.join(pools.select("round_id", "regime"), "round_id")
    combined = aggregate_predictions(joined, how, [*keys, "regime"], threshold)
    regimes = sorted(r[0] for r in pools.select("regime").distinct().collect())  # as many as pools
    wide = combined.groupBy(*keys).pivot("regime", regimes).agg(F.first("prediction"))
    return wide.withColumnsRenamed({str(r): f"regime_{r}_prediction" for r in regimes})


def rerun_pools(spec, data: DataFrame, rounds: Sequence[dict], pools: DataFrame, how: str = "mean", keys: Sequence[str] = ("series", "datetime"), threshold: float | None = None) -> DataFrame:
    """Train the chosen models (rounds[round_id]) again on other data, and combine their predictions per pool."""
    from ridgeline.operators.experiment import Experiment

    ids = sorted({r[0] for r in pools.select("round_id").collect()})  # as many as chosen models
    done = Experiment(spec, data).run(rounds=[rounds[i] for i in ids])
    number = F.element_at(F.array(*map(F.lit, ids)), C("round_id") + 1)
    return online_pools(done.predictions.withColumn("round_id", number), pools, how, keys, threshold)
