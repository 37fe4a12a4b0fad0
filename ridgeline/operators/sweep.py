"""Parameter sweeps: a space addressed by number, rounds as rows, one distributed job for all models."""

from __future__ import annotations

import inspect
import json
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import prod
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.columns import Series
from ridgeline.operators.prep import SPLITS


class ParamSpace:
    """The product of named value lists, by mixed-radix number; sampled without replacement, however large."""

    def __init__(self, params: dict[str, Sequence], n: int | None = None, seed: int | None = None):
        self.params = {k: list(v) for k, v in params.items()}
        self.size = prod(map(len, self.params.values()))
        rng = random.Random(seed)
        self._left = iter(range(self.size) if n is None or n >= self.size else rng.sample(range(self.size), n))
        self.n = self.size if n is None else min(n, self.size)

    def decode(self, index: int) -> dict:
        out = {}
        for name, values in reversed(self.params.items()):
            index, at = divmod(index, len(values))
            out[name] = values[at]
        return dict(reversed(out.items()))

    def generate(self) -> dict | None:
        """The next combination, None when there is none left."""
        index = next(self._left, None)
        return None if index is None else self.decode(index)

    def __iter__(self) -> Iterator[dict]:
        while (p := self.generate()) is not None:
            yield p


def resolve(value, params: dict):
    """A name that starts with _ or is a parameter is looked up; {name} in a string is filled in; else the value itself."""
    if isinstance(value, str):
        if value in params:
            return params[value]
        if value.startswith("_") and value[1:] in params:
            return params[value[1:]]
        if "{" in value:
            return value.format(**params)
    return value


def compute_features(df: DataFrame, steps: Sequence[tuple[Callable, dict]], rounds: Sequence[dict], s: Series) -> DataFrame:
    """Each distinct (feature, resolved parameters) of all rounds once, in the steps' order."""
    done = set()
    for f, kwargs in steps:
        for params in rounds:
            own = {k: resolve(v, params) for k, v in kwargs.items()}
            key = (f.__name__, repr(sorted(own.items())))
            if key not in done:
                done.add(key)
                df = f(df, s, **own)
    return df


# training: one round on one series in one task


def model_arguments(model: Callable, params: dict) -> dict[str, Any]:
    """The round's parameters that the model takes; one without a default must be there."""
    out = {}
    for name, p in list(inspect.signature(model).parameters.items())[1:]:
        if name in params:
            out[name] = params[name]
        elif p.default is inspect.Parameter.empty:
            raise ValueError(f"the model's parameter {name} is missing from the round")
    return out


@dataclass(frozen=True)
class Task:
    """What a round trains: model(data, **arguments) on these features. extension: may add to the data; rules: a scaling of features and target by name, fitted on the training rows."""

    model: Callable
    arguments: dict
    features: list[str]
    extension: Callable | None = None
    rules: dict[str, str] | None = None
    target: str | None = None


def train_rounds(packed: DataFrame, rounds: dict[int, Task], keys: Sequence[str]) -> DataFrame:
    """One row per round and series: round_id, keys, seconds, extras (JSON), rows (datetime, prediction, proba, actual of the test split).

    packed: round_id, keys, datetime, split, x, y. Rows with a null, NaN or infinite number, before or after scaling, are left out; a series
    that then has no two training rows or no test row in a round gives no row.
    """
    spec = T.StructType([T.StructField("round_id", T.IntegerType()), *(packed.schema[k] for k in keys), T.StructField("seconds", T.DoubleType()), T.StructField("extras", T.StringType())])
    test_row = T.StructType([packed.schema["datetime"], *(T.StructField(c, T.DoubleType()) for c in ("prediction", "proba", "actual"))])
    schema = T.StructType([*spec.fields, T.StructField("rows", T.ArrayType(test_row))])

    def train(pdf):
        import numpy as np
        import pandas as pd

        began = time.time()
        task = rounds[int(pdf["round_id"].iloc[0])]
        split = pdf["split"].to_numpy()
        own = np.column_stack([np.concatenate(pdf["x"].to_numpy()).astype(float).reshape(len(pdf), len(task.features)), pdf["y"].to_numpy(float)])
        if task.rules is not None:
            own = scaled(own, split == "train", [task.rules[c] for c in (*task.features, task.target)])
        order = np.argsort(pdf["datetime"].to_numpy(), kind="stable")
        order = order[np.isfinite(own[order]).all(axis=1)]
        own, split, when = own[order], split[order], pdf["datetime"].to_numpy()[order]
        if (split == "train").sum() < 2 or not (split == "test").any():
            return pd.DataFrame(columns=schema.names)
        data: dict[str, Any] = {"features": task.features}
        for s in SPLITS:
            data[f"x_{s}"], data[f"y_{s}"] = own[split == s, :-1], own[split == s, -1]
        if task.extension is not None:
            data = task.extension(data, task.arguments)
        got = task.model(data, **task.arguments)
        rows = [{"datetime": t, "prediction": float(p), "proba": float(q), "actual": float(a)} for t, p, q, a in zip(pd.Series(when[split == "test"]), got["prediction"], got.get("proba", got["prediction"]), data["y_test"], strict=True)]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in ("round_id", *keys)), round(time.time() - began, 3), json.dumps(got.get("extras", {})), rows]], columns=schema.names)

    return packed.groupBy("round_id", *keys).applyInPandas(train, schema)


def scaled(values, train, rules: Sequence[str]):
    """Columns scaled by prep.Scaler's rules with the training rows' figures; a number without a logarithm (log1p) becomes NaN and doesn't count."""
    import numpy as np

    out = values.copy()
    for j, rule in enumerate(rules):
        if rule == "none":
            continue
        v = values[:, j]
        if rule == "divide_100":
            out[:, j] = v / 100.0
            continue
        lost = np.zeros(len(v), bool)
        if rule == "log_standard":
            lost = v <= -1
            v = np.log1p(np.where(lost, 0, v))
        fit = v[train & ~lost]
        sd = fit.std() if len(fit) else np.nan
        out[:, j] = np.where(lost, np.nan, (v - (fit.mean() if len(fit) else np.nan)) / (1.0 if sd == 0 else sd))
    return out


def _standardised(data: dict) -> dict:
    import numpy as np

    mu, sd = data["x_train"].mean(axis=0), data["x_train"].std(axis=0)
    return data | {k: (data[k] - mu) / np.where(sd == 0, 1, sd) for k in ("x_train", "x_val", "x_test")}


def _sweep_model(name: str, p: dict) -> Callable:
    """The models of run_sweep by name, with a round's parameters."""
    from ridgeline.operators import models

    if name == "logreg":
        return lambda data: models.logreg_binary(_standardised(data), float(p.get("c", 1.0)), float(p.get("class_weight", 1.0)), 50, 1e-10)
    if name == "random":
        return lambda data: models.random_binary(data, float(p.get("random_weight", 0.5)), int(p.get("seed", 0)))
    if name != "boosted":
        raise ValueError(f"unknown model: {name}")
    own = {k: p[k] for k in ("learning_rate", "max_depth", "n_estimators", "min_child_weight", "subsample", "colsample_bytree", "gamma", "reg_alpha", "reg_lambda", "early_stopping_rounds") if k in p}
    return lambda data: models.boosted_regressor(_standardised(data), **{"learning_rate": 0.1, "n_estimators": 50, "early_stopping_rounds": 10, **own})


def run_sweep(prepared: DataFrame, rounds: Sequence[dict], features: Callable[[dict], Sequence[str]], target: Callable[[dict], str], model: str = "logreg", keys: Sequence[str] = ("series",)) -> DataFrame:
    """Predictions on the test split: round_id, keys, datetime, prediction, proba, actual.

    prepared: keys, datetime, split and all feature and target columns, computed
    once for all rounds. Each round takes its own columns of a row along, packed; each
    (round, series) is one task's group. Features are standardised with the training split's figures.
    """
    packs = [F.struct(F.lit(i).alias("round_id"), F.array(*(F.col(c).cast("double") for c in features(p))).alias("x"), F.col(target(p)).cast("double").alias("y")) for i, p in enumerate(rounds)]
    packed = prepared.select(*keys, "datetime", "split", F.explode(F.array(*packs)).alias("p")).select(*keys, "datetime", "split", "p.*").where("y IS NOT NULL")
    got = train_rounds(packed, {i: Task(_sweep_model(model, p), {}, list(features(p))) for i, p in enumerate(rounds)}, keys)
    return got.select("round_id", *keys, F.explode("rows").alias("r")).select("round_id", *keys, "r.*")


def experiment_log(metrics: DataFrame, rounds: Sequence[dict]) -> DataFrame:
    """Metrics by round with the round's parameters."""
    names = sorted({k for p in rounds for k in p})
    rows = [(i, *(str(p.get(n)) for n in names)) for i, p in enumerate(rounds)]
    return metrics.join(F.broadcast(metrics.sparkSession.createDataFrame(rows, ["round_id", *names])), "round_id")


def calibrate(df: DataFrame, proba: str = "proba", actual: str = "actual", method: str = "isotonic", keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """Add `calibrated`: each model's probabilities after a calibration fitted on its validation rows (isotonic or sigmoid).

    A model's distinct probabilities are counted before they meet in one task. Models without validation rows get null.
    """
    from ridgeline.operators import models

    if method not in ("isotonic", "sigmoid"):
        raise ValueError("method must be isotonic or sigmoid")
    keys = list(keys)
    counted = df.where(F.col("split") == "val").groupBy(*keys, F.col(proba).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(actual).cast("double")).alias("good")).where("x IS NOT NULL AND good IS NOT NULL")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("__xs", T.ArrayType(T.DoubleType())), T.StructField("__ys", T.ArrayType(T.DoubleType()))])

    def fit(key, pdf):
        import numpy as np
        import pandas as pd

        x, good, n = (pdf[c].to_numpy(float) for c in ("x", "good", "n"))
        if method == "isotonic":
            xs, ys = models.isotonic(x, good / n, n)
        else:
            xs, ys = [0.0], models.platt(np.concatenate([x, x]), np.repeat([1.0, 0.0], len(x)), np.concatenate([good, n - good]))
        return pd.DataFrame([[*key, list(map(float, xs)), list(map(float, ys))]], columns=schema.names)

    rows = df.join(counted.groupBy(*keys).applyInPandas(fit, schema), keys, "left")
    x = F.col(proba).cast("double")
    if method == "sigmoid":
        out = 1 / (1 + F.exp(-(F.element_at("__ys", 1) * x + F.element_at("__ys", 2))))
    else:  # between two breakpoints a line, outside of them the nearest
        at = F.size(F.filter("__xs", lambda v: v <= x))
        x0, x1, y0, y1 = (F.try_element_at(c, at + d) for c in ("__xs", "__ys") for d in (0, 1))
        out = F.when(at == 0, F.element_at("__ys", 1)).when(at >= F.size("__xs"), F.element_at("__ys", -1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return rows.withColumn("calibrated", F.when(x.isNotNull(), out)).drop("__xs", "__ys")
