"""Logistic regression over rows of any number: Newton steps from grouped sums, all rounds and series in each step at once.

sweep.train_rounds gives each (round, series) to one task, with all its rows. Here rows stay where they are: in each step a task adds up the
gradient and the Gram matrix of the rows that it reads, by round and series; these partial sums, of a size that depends on
the number of features only, are added by a grouped aggregation, and each (round, series) solves its small
system. Models that have converged leave the next step. No group of rows is gathered, and nothing but the count of open models comes to the driver.

The fit equals models.fit_logistic on the same rows: weights of class 0, a penalty that spares the bias, the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.plans.staging import Staged

C = F.col
#: Coefficients are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: A task adds its partial sums up in memory for so many models, then hands them on.
MOST_OPEN = 2_000


def finite_rows(packed: DataFrame) -> DataFrame:
    """Rows whose numbers are all finite, as train_rounds takes them."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return packed.where(real(C("y")) & F.forall("x", real))


def scaled(packed: DataFrame, rules: Mapping[int, Sequence[str]], keys: Sequence[str] = ("series",)) -> DataFrame:
    """x and y of each round scaled by prep.Scaler's rules (those of the features, then of the target) with its training rows' figures.

    A number without a logarithm becomes null, and the row goes. One aggregation with partial sums for all rounds.
    """
    spark, by = packed.sparkSession, ["round_id", *keys]
    named = spark.createDataFrame([(i, list(r)) for i, r in rules.items()], "round_id int, __rules array<string>")
    all_values = F.concat("x", F.array("y"))
    based = F.zip_with(all_values, "__rules", lambda v, r: F.when(r == "log_standard", F.when(v > -1, F.log1p(v))).when(r == "divide_100", v / 100.0).otherwise(v))
    rows = packed.join(F.broadcast(named), "round_id").withColumn("__v", based)
    width = max(map(len, rules.values()), default=0)
    of = lambda f: F.array(*(f(F.get("__v", i)) for i in range(width)))
    fitted = rows.where("split = 'train'").groupBy(*by).agg(of(F.avg).alias("__mean"), of(F.stddev_pop).alias("__sd"))
    small = spark_small(fitted, 16 * width)
    out = rows.join(F.broadcast(fitted) if small else fitted, by, "left")
    new = F.transform("__v", lambda v, i: F.when(F.get("__rules", i).endswith("standard"), (v - F.get("__mean", i)) / F.when(F.get("__sd", i) == 0, 1.0).otherwise(F.get("__sd", i))).otherwise(v))
    out = out.withColumn("__v", new).where(F.forall("__v", lambda v: v.isNotNull()))
    return out.select(*by, *(c for c in packed.columns if c not in (*by, "x", "y")), F.slice("__v", F.lit(1), F.size("__v") - 1).alias("x"), F.element_at("__v", -1).alias("y"))


def spark_small(df: DataFrame, bytes_a_row: int) -> bool:
    """Whether so many rows stay below the broadcast limit, by a count."""
    return df.count() * (bytes_a_row + 64) <= BROADCAST_BYTES


def _partial_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, sums: of the rows that a task reads, the gradient and the Gram matrix's upper half, by model. rows: by, x, y, beta, zero_weight."""
    k = len(by)
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("sums", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, rows_type) for c, rows_type in zip(zip(*open_sums, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(open_sums.values()), pa.list_(pa.float64()))], names=schema.names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(k)]
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for i in range(k):
                own = batch.column(i).dictionary_encode()
                codes = codes * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0, [True]]))
            y, weight = (batch.column(k + i).to_numpy(zero_copy_only=False) for i in (1, 3))
            x, beta = batch.column(k), batch.column(k + 2)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[lo:hi]
                name = tuple(batch.column(i)[int(own[0])].as_py() for i in range(k))
                b = np.array(beta[int(own[0])].as_py())
                x1 = np.column_stack([x.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), len(b) - 1), np.ones(len(own))])
                p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
                w = np.where(y[own] == 1, 1.0, weight[own])
                gram = (x1.T * (w * p * (1 - p))) @ x1
                sums = np.concatenate([x1.T @ (w * (p - y[own])), gram[np.triu_indices(len(b))]])
                open_sums[name] = open_sums[name] + sums if name in open_sums else sums
            if len(open_sums) >= MOST_OPEN:
                yield out()
                open_sums.clear()
        if open_sums:
            yield out()

    return rows.select(*by, "x", "y", "beta", "zero_weight").mapInArrow(run, schema)


def _solved(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state after a step. state: by, beta, settings, steps, and sums as values by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                b, sums = np.array(r["beta"]), np.array(r["sums"])
                penalty = np.full(len(b), 1.0 / r["c"])
                penalty[-1] = 1e-9
                gram = np.zeros((len(b), len(b)))
                gram[np.triu_indices(len(b))] = sums[len(b) :]
                gram = np.triu(gram) + np.triu(gram, 1).T + np.diag(penalty + 1e-9)
                step = np.linalg.solve(gram, sums[: len(b)] + penalty * b)
                r["beta"], r["steps"] = (b - step).tolist(), r["steps"] + 1
                r["done"] = bool(np.abs(step).max() < r["tol"]) or r["steps"] >= r["max_iter"]
                del r["sums"]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([f for f in batch.schema if f.name != "sums"]))

    return state.mapInArrow(run, T.StructType([f for f in state.schema if f.name != "sums"]))


def fit_logistic(packed: DataFrame, settings: Mapping[int, Mapping], keys: Sequence[str] = ("series",)) -> DataFrame:
    """round_id, keys, beta (a coefficient for each feature, then the bias), steps. settings: by round C, class_weight (of class 0), max_iter and tol.

    packed: round_id, keys, split, x, y, as experiments prepare it; rows that aren't finite are left out, and models with fewer than two training rows.
    The training rows are written once; each step reads them.
    """
    spark, by = packed.sparkSession, ["round_id", *keys]
    named = spark.createDataFrame(
        [(i, float(s.get("C", 1.0)), float(s.get("class_weight", 1.0)), int(s.get("max_iter", 100)), float(s.get("tol", 1e-4))) for i, s in settings.items()], "round_id int, c double, zero_weight double, max_iter int, tol double"
    )
    rows = Staged(finite_rows(packed).where("split = 'train'").select(*by, "x", "y"))
    first = rows.df.groupBy(*by).agg(F.count("*").alias("__n"), F.max(F.size("x")).alias("__d")).where("__n > 1")
    first = first.join(F.broadcast(named), "round_id").select(*by, F.array_repeat(F.lit(0.0), C("__d") + 1).alias("beta"), "c", "zero_weight", "max_iter", "tol", F.lit(0).alias("steps"), (C("max_iter") < 1).alias("done"))
    state = Staged(first)
    while left := state.df.where("NOT done").agg(F.count("*"), F.max(F.size("beta"))).first():
        n_open, width = left
        if not n_open:
            break
        now = state.df.where("NOT done")
        betas = now.select(*by, "beta", "zero_weight")
        near = F.broadcast(betas) if n_open * (8 * width + 64) <= BROADCAST_BYTES else betas
        parts = _partial_sums(rows.df.join(near, by), by).select(*by, F.posexplode("sums").alias("at", "v"))
        sums = parts.groupBy(*by, "at").agg(F.sum("v").alias("v")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("sums"))  # a list of a matrix's entries
        after = Staged(_solved(now.join(sums, by), by).unionByName(state.df.where("done")))
        state.drop()
        state = after
    rows.drop()
    return state.df.select(*by, "beta", "steps")


def probability(x: str | Column = "x", beta: str | Column = "beta") -> Column:
    """The model's probability of a row; whole in the JVM."""
    x, beta = (C(c) if isinstance(c, str) else c for c in (x, beta))
    z = F.aggregate(F.zip_with(x, F.slice(beta, F.lit(1), F.size(beta) - 1), lambda a, b: a * b), F.element_at(beta, -1), lambda a, b: a + b)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def predict(packed: DataFrame, fitted: DataFrame, keys: Sequence[str] = ("series",), threshold: float = 0.5) -> DataFrame:
    """round_id, keys, datetime, prediction, proba, actual of the test rows, as an experiment's predictions."""
    by = ["round_id", *keys]
    width = fitted.agg(F.max(F.size("beta"))).first()[0] or 0
    betas = fitted.select(*by, "beta")
    test = finite_rows(packed).where("split = 'test'")
    out = test.join(F.broadcast(betas) if spark_small(betas, 8 * width) else betas, by).withColumn("proba", probability())
    return out.select(*by, "datetime", (C("proba") >= threshold).cast("double").alias("prediction"), "proba", C("y").alias("actual"))
