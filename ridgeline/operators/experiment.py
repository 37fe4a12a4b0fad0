"""Experiments: a manifest declares how rows become a model's data; a loop runs many rounds as one Spark job.

Preparation is a plan of DataFrame operations: selection, split, bars, features, target and scaling,
with everything fitted on the training split. All rounds are prepared as one graph (operators/graph.py), in which steps
that rounds have in common are computed once. A round's prepared rows are packed (features as one array),
so that rounds with different features stand in one table, and each (round, series) is one task's group.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, drop_null_rows
from ridgeline.operators import evaluation as ev
from ridgeline.operators import large_models, models, prep
from ridgeline.operators.graph import FeatureGraph, staged_in
from ridgeline.operators.sweep import ParamSpace, Task, model_arguments, resolve, train_rounds
from ridgeline.plans.staging import Staged

C = F.col


def resolve_source(source: Callable, spark: SparkSession, params: dict[str, Any]) -> DataFrame:
    """Rows of a source: a function or bound method of (spark, **params); of a class's plain method, an instance is made first."""
    if inspect.isfunction(source) and "." in source.__qualname__ and "<locals>" not in source.__qualname__:
        import importlib

        owner = reduce(getattr, source.__qualname__.split(".")[:-1], importlib.import_module(source.__module__))
        if not isinstance(inspect.getattr_static(owner, source.__name__), staticmethod):
            source = getattr(owner(), source.__name__)
    return source(spark, **params)


def _resolved(kwargs: dict[str, Any], params: dict[str, Any]) -> dict[str, Any]:
    return {k: resolve(v, params) for k, v in kwargs.items()}


class TargetBuilder:
    """The target's steps: transforms of all rows, and fitted ones."""

    def __init__(self, manifest: Manifest):
        self.manifest = manifest

    def add_transform(self, f: Callable, **params: Any) -> TargetBuilder:
        self.manifest.target_steps.append(([], f, params))
        return self

    def add_fitted_transform(self, f: Callable) -> FittedTransformBuilder:
        return FittedTransformBuilder(self, f)

    def done(self) -> Manifest:
        return self.manifest


class FittedTransformBuilder:
    """Values fitted on the training split (one per series), and then the transform that takes them by name."""

    def __init__(self, target: TargetBuilder, f: Callable):
        self.target, self.f, self.fits = target, f, []

    def fit_param(self, name: str, fit: Callable, **params: Any) -> FittedTransformBuilder:
        """fit(train, keys, **params) returns keys and a column `value`."""
        self.fits.append((name, fit, params))
        return self

    def with_params(self, **params: Any) -> TargetBuilder:
        self.target.manifest.target_steps.append((self.fits, self.f, params))
        return self.target


@dataclass
class Prepared:
    """rows: keys, datetime, split, features, target (the last column). bars: the rows before features."""

    rows: DataFrame
    bars: DataFrame
    keys: tuple[str, ...]
    features: list[str]
    target: str
    scaler: prep.Scaler | None = None
    fitted: DataFrame | None = None

    def missing(self) -> DataFrame:
        """Times that preparation lost."""
        return prep.missing_datetimes(self.bars, self.rows, self.keys)

    def test_range(self) -> DataFrame:
        """keys, first_test_datetime, last_test_datetime."""
        return self.rows.where("split = 'test'").groupBy(*self.keys).agg(F.min("datetime").alias("first_test_datetime"), F.max("datetime").alias("last_test_datetime"))

    def packed(self, round_id: int) -> DataFrame:
        return self.rows.select(F.lit(round_id).alias("round_id"), *self.keys, "datetime", "split", F.array(*(C(c).cast("double") for c in self.features)).alias("x"), C(self.target).cast("double").alias("y"))


@dataclass
class Manifest:
    """What a model's data is made of. Values of parameters are looked up in the round by name, as in sweep.resolve."""

    source: tuple[Callable, dict] | None = None
    test_source: tuple[Callable, dict] | None = None
    selector: tuple[Callable, dict] | None = None
    bars: tuple[Callable, dict] | None = None
    required: list[str] = field(default_factory=list)
    ratios: tuple[float, float, float] = (8, 1, 2)
    features: list[tuple[Callable, dict]] = field(default_factory=list)
    target: str | None = None
    target_steps: list[tuple[list, Callable, dict]] = field(default_factory=list)
    scaler_rules: Any = None
    model: Callable | None = None
    extension: Callable | None = None

    def set_data_source(self, method: Callable, params: dict | None = None) -> Manifest:
        self.source = (method, params or {})
        return self

    def set_test_data_source(self, method: Callable, params: dict | None = None) -> Manifest:
        self.test_source = (method, params or {})
        return self

    def fetch_data(self, spark: SparkSession) -> DataFrame:
        if self.source is None:
            raise ValueError("the manifest names no data source")
        return resolve_source(self.source[0], spark, self.source[1])

    def fetch_test_data(self, spark: SparkSession) -> DataFrame:
        if self.test_source is None:
            raise ValueError("the manifest names no test data source")
        return resolve_source(self.test_source[0], spark, self.test_source[1])

    def set_pre_split_data_selector(self, f: Callable, **params: Any) -> Manifest:
        self.selector = (f, params)
        return self

    def set_bar_formation(self, f: Callable, **params: Any) -> Manifest:
        self.bars = (f, params)
        return self

    def set_required_bar_columns(self, columns: Sequence[str]) -> Manifest:
        self.required = list(columns)
        return self

    def set_split_config(self, train: float, val: float, test: float) -> Manifest:
        self.ratios = (train, val, test)
        return self

    def add_feature(self, f: Callable, **params: Any) -> Manifest:
        """f(df, series, **params) adds columns."""
        self.features.append((f, params))
        return self

    add_indicator = add_feature

    def with_target(self, column: str) -> TargetBuilder:
        self.target = column
        return TargetBuilder(self)

    def set_scaler(self, rules) -> Manifest:
        """Rules as in prep.Scaler, for all features and the target."""
        self.scaler_rules = rules
        return self

    def with_model(self, model: Callable) -> Manifest:
        self.model = model
        return self

    def add_to_data_dict(self, f: Callable) -> Manifest:
        """f(data, params) may add entries to a task's data before the model takes it."""
        self.extension = f
        return self

    def test_bars(self, raw: DataFrame, params: dict, keys: Sequence[str] = ("series",)) -> DataFrame:
        """The test split's rows, before features."""
        return self._bars(raw, params, keys).where("split = 'test'")

    def _bars(self, raw: DataFrame, params: dict, keys: Sequence[str]) -> DataFrame:
        if self.selector:
            raw = self.selector[0](raw, **_resolved(self.selector[1], params))
        df = prep.split_sequential(raw, self.ratios, keys)
        if self.bars and params.get("bar_type", "base") != "base":
            df = self.bars[0](df, keys=(*keys, "split"), **_resolved(self.bars[1], params))
        if lost := [c for c in ("datetime", *self.required) if c not in df.columns]:
            raise ValueError(f"columns missing after bar formation: {lost}")
        return df

    def prepare(self, raw: DataFrame, params: dict | None = None, keys: Sequence[str] = ("series",)) -> Prepared:
        """Every step of the manifest under one round's parameters; nothing runs yet."""
        params, keys = dict(params or {}), tuple(keys)
        s = Series((*keys, "split"), ("datetime",))
        df = bars = self._bars(raw, params, keys)
        for f, kwargs in self.features:
            df = f(df, s, **_resolved(kwargs, params))
        own, values = {**params, "target_column": self.target}, []
        for fits, f, kwargs in self.target_steps:
            for name, fit, fit_kwargs in fits:
                column = f"__fit_{len(values)}"
                df = df.join(fit(df.where("split = 'train'"), keys, **_resolved(fit_kwargs, own)).withColumnRenamed("value", column), list(keys), "left")
                own[name] = C(column)
                values.append(column)
            df = f(df, s, **_resolved(kwargs, own))
        if self.target is None or self.target not in df.columns:
            raise ValueError(f"no target column: {self.target}")
        df = drop_null_rows(df.drop(*values))
        features = [c for c in df.columns if c not in (*keys, "datetime", "split", self.target)]
        scaler = fitted = None
        if self.scaler_rules is not None:
            scaler = prep.Scaler([*features, self.target], self.scaler_rules, keys)
            fitted = scaler.fit(df)
            df = drop_null_rows(scaler.transform(df, fitted))
        return Prepared(df.select(*keys, "datetime", "split", *features, self.target), bars, keys, features, self.target, scaler, fitted)


class Experiment:
    """Rounds of a spec over data. spec: an object with params() and manifest(), or with params(), prep(df, params) -> Prepared and model(data, **params)."""

    def __init__(self, spec: Any, data: DataFrame | None = None, spark: SparkSession | None = None, keys: Sequence[str] = ("series",), test: bool = True):
        self.spec, self.keys = spec, tuple(keys)
        self.manifest = spec.manifest() if hasattr(spec, "manifest") else None
        if self.manifest is not None and self.manifest.model is None:
            raise ValueError("the manifest has no model")
        if data is None:
            if self.manifest is None:
                raise ValueError("a spec with its own prep needs data")
            spark = spark or SparkSession.getActiveSession()
            data = self.manifest.fetch_test_data(spark) if test and self.manifest.test_source else self.manifest.fetch_data(spark)
        self.data = data

    def run(self, n: int | None = None, seed: int | None = None, random_search: bool = True, context: dict | None = None, params: dict | None = None, prep_each_round: bool = True, save_to: str | None = None, rounds: Sequence[dict] | None = None, stage_in: str | None = None) -> Experiment:
        """Prepare and train n rounds of the space (default: all), or the given ones. Sets rounds, graph and outcomes.

        save_to: a folder where the outcomes are written once, else each use trains again. stage_in: a folder, shared by all executors,
        where the features of all rounds are written once before anything is fitted on them, so that the source is scanned
        once; else fits read the source for themselves.
        """
        if rounds is None:
            space = ParamSpace(params or self.spec.params(), n, seed)
            rounds = space if random_search else map(space.decode, range(space.n))
        self.rounds, self._prepared = [{**p, **(context or {})} for p in rounds], {}
        if self.manifest is not None:
            if not prep_each_round:
                raise ValueError("a manifest prepares each round")
            self.graph = FeatureGraph(self.manifest, self.data, self.rounds, self.keys, staged_in(stage_in) if stage_in else None)
            model, scaler = self.manifest.model, self.manifest.scaler_rules
            rules = {tuple(f): prep.Scaler([*f, self.manifest.target], scaler, self.keys).rule for f in self.graph.features} if scaler is not None else {}
            own = {i: Task(model, model_arguments(model, p), self.graph.features[i], self.manifest.extension, rules.get(tuple(self.graph.features[i])), self.manifest.target) for i, p in enumerate(self.rounds)}
            packed = self.graph.packed
        else:
            first = None if prep_each_round or not self.rounds else self.spec.prep(self.data, self.rounds[0])
            self._prepared = {i: first or self.spec.prep(self.data, p) for i, p in enumerate(self.rounds)}
            packed = reduce(DataFrame.unionByName, (p.packed(i) for i, p in self._prepared.items()))
            own = {i: Task(self.spec.model, model_arguments(self.spec.model, p), self._prepared[i].features) for i, p in enumerate(self.rounds)}
        self.outcomes = train_rounds(packed, own, self.keys)
        if save_to is not None:
            self.outcomes.write.mode("overwrite").parquet(save_to)
            self.outcomes = self.data.sparkSession.read.parquet(save_to)
        return self

    def prepared(self, round_id: int) -> Prepared:
        """One round's rows, prepared for themselves."""
        if round_id not in self._prepared:
            self._prepared[round_id] = self.manifest.prepare(self.data, self.rounds[round_id], self.keys)
        return self._prepared[round_id]

    def fit_large(self, n: int | None = None, seed: int | None = None, rounds: Sequence[dict] | None = None) -> DataFrame:
        """Predictions of logistic regressions over series of any length: as run() for such a manifest, but no series is gathered in a task."""
        if self.manifest is None or self.manifest.model is not models.logreg_binary or self.manifest.extension is not None:
            raise ValueError("only a manifest with logreg_binary, and without additions to its data, is fitted this way")
        self.rounds, self._prepared = [dict(p) for p in (ParamSpace(self.spec.params(), n, seed) if rounds is None else rounds)], {}
        self.graph = FeatureGraph(self.manifest, self.data, self.rounds, self.keys)
        packed = self.graph.packed
        if self.manifest.scaler_rules is not None:
            rules = {i: prep.Scaler([*f, self.manifest.target], self.manifest.scaler_rules, self.keys).rule for i, f in enumerate(self.graph.features)}
            packed = large_models.scaled(packed, {i: [r[c] for c in (*self.graph.features[i], self.manifest.target)] for i, r in rules.items()}, self.keys)
        packed = Staged(packed).df
        self.coefficients = large_models.fit_logistic(packed, {i: model_arguments(models.logreg_binary, p) for i, p in enumerate(self.rounds)}, self.keys)
        return large_models.predict(packed, self.coefficients, self.keys)

    @property
    def predictions(self) -> DataFrame:
        return self.outcomes.select("round_id", *self.keys, F.explode("rows").alias("r")).select("round_id", *self.keys, "r.*")

    def parameters(self) -> DataFrame:
        """round_id and the rounds' parameters as text."""
        names = list(dict.fromkeys(itertools.chain.from_iterable(self.rounds)))
        schema = "round_id int" + "".join(f", `{n}` string" for n in names)
        return self.data.sparkSession.createDataFrame([(i, *(str(p[n]) if n in p else None for n in names)) for i, p in enumerate(self.rounds)], schema)

    def log(self, metrics: Callable[..., DataFrame] = ev.binary_metrics) -> DataFrame:
        """Per round and series: the metrics, the seconds that the model took, extras and the parameters."""
        keys = ["round_id", *self.keys]
        return metrics(self.predictions, keys=keys).join(self.outcomes.select(*keys, "seconds", "extras"), keys).join(F.broadcast(self.parameters()), "round_id")

    def test_rows(self, round_id: int) -> DataFrame:
        """The bars of a round's test window with all columns, without the times that preparation lost."""
        p = self.prepared(round_id)
        within = p.bars.where("split = 'test'").join(F.broadcast(p.test_range()), list(p.keys)).where("datetime BETWEEN first_test_datetime AND last_test_datetime")
        return within.join(p.missing(), [*p.keys, "datetime"], "left_anti").drop("first_test_datetime", "last_test_datetime")

    def performance(self) -> DataFrame:
        """Predictions with their bars' prices, hit or miss, of all rounds."""
        if self.manifest is None:
            bars = reduce(DataFrame.unionByName, (self.test_rows(i).select(F.lit(i).alias("round_id"), *self.keys, "datetime", "open", "close") for i in range(len(self.rounds))))
            return ev.prediction_performance(self.predictions, bars, ("round_id", *self.keys))
        bases = self.data.sparkSession.createDataFrame(list(enumerate(self.graph.base_of)), "round_id int, base int")
        found = ev.prediction_performance(self.predictions.join(F.broadcast(bases), "round_id"), self.graph.bars(), ("base", *self.keys))
        return found.drop("base").select("round_id", *(c for c in found.columns if c not in ("round_id", "base")))

    def confusion(self, x: str, **options) -> DataFrame:
        """The parameters of each round, then its confusion metrics."""
        keys = ["round_id", *self.keys]
        return F.broadcast(self.parameters()).join(ev.confusion_metrics(self.performance(), x, keys=keys, **options), "round_id")

    def backtest(self, **options) -> DataFrame:
        return ev.backtest_snapshot(self.performance(), keys=("round_id", *self.keys), **options)


def one_hot(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as one 0/1 column for each value, named column_value. The log has a row per round, so its values are few."""
    for c in columns:
        values = [r[0] for r in log.select(c).where(C(c).isNotNull()).distinct().orderBy(c).collect()]
        log = log.withColumns({f"{c}_{v}": F.coalesce((C(c) == v).cast("int"), F.lit(0)) for v in values}).drop(c)
    return log


def quantile_cutoff(train: DataFrame, keys: Sequence[str], col: str, q: float) -> DataFrame:
    """The training rows' (1 - q) quantile ('nearest') of each series: keys, value."""
    return prep.quantiles(train, keys, {"value": (col, 1.0 - q)})


def _many_cutoffs(train: DataFrame, keys: Sequence[str], wanted: dict[str, dict]) -> DataFrame:
    """The cut-offs of many rounds, by name, from one ranking."""
    return prep.quantiles(train, keys, {name: (own["col"], 1.0 - own["q"]) for name, own in wanted.items()})


quantile_cutoff.many = _many_cutoffs


def flag_above(df: DataFrame, s: Series, target_column: str, col: str, cutoff: Column) -> DataFrame:
    """1 where the column is above the fitted cut-off."""
    return df.withColumn(target_column, (C(col) > cutoff).cast("int"))


def shifted(df: DataFrame, s: Series, column: str, shift: int) -> DataFrame:
    """A column of the row `shift` rows before (below zero: after) within the series and split."""
    return df.withColumn(column, s.lag(column, shift))
