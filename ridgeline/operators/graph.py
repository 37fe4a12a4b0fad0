"""One plan for the rows of many rounds: each step's distinct (function, arguments, inputs) is computed once.

A manifest's steps are functions from frames to frames, so a step's inputs are found by asking: it runs on an empty frame that
has the raw columns only, and on one with those earlier columns that it misses, until it resolves. Columns that pass
unchanged keep a mark in their schema; a step's outputs are those without it. Rounds whose steps agree
in function, arguments and inputs share a node. A node's columns stand once in a wide frame, under a name of their own where two
nodes make the same one. A step that changes rows (its plan has more than projections and windows) opens a frame of its own, which
rounds with the same steps up to there share.

The rounds are exploded at the end: a row's columns are one array, and each round takes its places from it, so that
the plan's size doesn't grow with the number of rounds. Fits that offer `many` are one aggregation for all rounds.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.columns import Series
from ridgeline.operators import prep

C = F.col
_MARK = "ridgeline_column"
#: Operators that keep every row and add none.
_ROW_BY_ROW = {"Project", "Window", "LogicalRDD", "LocalRelation", "SubqueryAlias", "View"}


def frozen(value: Any) -> Any:
    """A hashable stand-in for an argument."""
    if isinstance(value, dict):
        return tuple(sorted((k, frozen(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(map(frozen, value))
    return value if value.__hash__ is not None else repr(value)


def changes_rows(df: DataFrame) -> bool:
    """Whether the plan may drop, add or join rows."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(True)
    analysed = said.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0].splitlines()[2:]
    return any((m := re.match(r"[\s:+\-]*([A-Z]\w+)", line)) and m[1] not in _ROW_BY_ROW for line in analysed if line.strip())


@contextlib.contextmanager
def _quiet():
    """Without Spark's log lines on questions whose answer may be no."""
    log = PySparkLogger.getLogger("DataFrameQueryContextLogger")  # of its own class, which must exist before a plain one of the name
    before, log.disabled = log.disabled, True
    try:
        yield
    finally:
        log.disabled = before


@dataclass
class Frame:
    """Rows with the columns of many rounds. schema: types by column; made: the nodes whose columns it has."""

    key: tuple
    df: DataFrame
    bars: DataFrame
    raw: list[str]
    schema: dict[str, T.StructField]
    made: dict[tuple, dict[str, str]] = field(default_factory=dict)
    waiting: dict[tuple, tuple] = field(default_factory=dict)  # fits: key -> (name, fit, arguments, inputs)


@dataclass
class Round:
    """One round's place: its frame, and the frame's column of each of its own columns, in order."""

    frame: Frame
    view: dict[str, str]
    fitted: dict[str, str] = field(default_factory=dict)


class FeatureGraph:
    """The prepared rows of all rounds of a manifest. Sets packed, rounds (features by round), frames.

    staged: called with a frame that several aggregations read, to write it once.
    """

    def __init__(self, manifest, data: DataFrame, rounds: Sequence[dict], keys: Sequence[str] = ("series",), staged: Callable[[DataFrame], DataFrame] | None = None):
        self.manifest, self.data, self.keys, self.params = manifest, data, tuple(keys), list(rounds)
        self.series = Series((*self.keys, "split"), ("datetime",))
        self.frames: dict[tuple, Frame] = {}
        self._asked: dict[tuple, T.StructType | str] = {}
        self._changing: dict[tuple, bool] = {}
        self._probes: dict[str, DataFrame] = {}
        self._bases: dict[tuple, Frame] = {}
        self.nodes, self.base_of = 0, []
        from ridgeline.operators.experiment import _resolved

        self.places = [self._base(p) for p in self.params]
        for f, kwargs in manifest.features:
            self._step(f, [_resolved(kwargs, p) for p in self.params])
        own = [{**p, "target_column": manifest.target} for p in self.params]
        for fits, f, kwargs in manifest.target_steps:
            if fits and staged is not None:
                for frame in self.frames.values():
                    if any(r.frame is frame for r in self.places):
                        frame.df = staged(frame.df)
            for name, fit, fit_kwargs in fits:
                for r, p in zip(self.places, own, strict=True):
                    column = self._fit(r, fit, _resolved(fit_kwargs, p))
                    r.fitted[column] = name
                    p[name] = _Fitted(column)
            self._join_fits()
            self._step(f, [_resolved(kwargs, p) for p in own])
        if manifest.target is None or any(manifest.target not in r.view for r in self.places):
            raise ValueError(f"no target column: {manifest.target}")
        self.features = [[c for c in r.view if c != manifest.target] for r in self.places]
        self.packed = reduce(DataFrame.unionByName, (self._exploded(f, [i for i, r in enumerate(self.places) if r.frame is f]) for f in self.frames.values() if any(r.frame is f for r in self.places)))

    # frames and steps

    def _base(self, params: dict) -> Round:
        from ridgeline.operators.experiment import _resolved

        m = self.manifest
        steps = [x for x in (m.selector, m.bars if params.get("bar_type", "base") != "base" else None) if x]
        key = tuple((f, frozen(_resolved(kwargs, params))) for f, kwargs in steps)
        if key not in self._bases:
            df = m._bars(self.data, params, self.keys)
            raw = [c for c in df.columns if c not in (*self.keys, "datetime", "split")]
            self._bases[key] = self.frames[key] = Frame(key, df, df, raw, {f.name: f for f in df.schema})
        frame = self._bases[key]
        self.base_of.append(list(self._bases).index(key))
        return Round(frame, {c: c for c in frame.raw})

    def _probe(self, columns: dict[str, T.StructField]) -> DataFrame:
        """An empty frame with these columns, each with its mark."""
        schema = T.StructType([T.StructField(c, f.dataType, True, {_MARK: c}) for c, f in columns.items()])
        name = schema.json()
        if name not in self._probes:
            self._probes[name] = self.data.sparkSession.createDataFrame([], schema)
        return self._probes[name]

    def _ask(self, r: Round, f: Callable, own: dict, call: Callable[[DataFrame], DataFrame], fitted: Sequence[str] = ()) -> tuple[dict[str, str], T.StructType, bool]:
        """A step's inputs among the round's columns that aren't raw, the schema of its result on all of them, and whether it changes rows.

        Answers depend on the columns' names and types only, so rounds that differ in contents ask once. A step that uses a column
        if it is there must leave one of that name behind where it isn't.
        """
        frame, view = r.frame, r.view
        made = {c for c in view if c not in frame.raw or view[c] != c}
        types = {**{c: frame.schema[c] for c in (*self.keys, "datetime", "split")}, **{c: frame.schema[o] for c, o in view.items()}, **{c: frame.schema[c] for c in fitted}}
        what = (f, frozen({k: "a fitted value" if isinstance(v, _Fitted) else v for k, v in own.items()}))
        wanted: set[str] = set()
        while True:
            part = {c: t for c, t in types.items() if c not in made or c in wanted}
            schema = self._try(what, call, part)
            if not isinstance(schema, str):
                break
            if schema not in made or schema in wanted:
                wanted, schema = made, self._try(what, call, types)
                if isinstance(schema, str):
                    call(self._probe(types))  # it can't be computed: say so
                break
            wanted.add(schema)
        outputs = {s.name: s for s in schema if s.metadata.get(_MARK) != s.name}
        if outputs.keys() & (made - wanted):  # it may look for columns that are there already, which then are inputs
            wanted, schema = made, call(self._probe(types)).schema
        else:
            lost = {c for c in part if c not in schema.names}
            schema = T.StructType([*(outputs.get(c) or T.StructField(c, t.dataType, True, {_MARK: c}) for c, t in types.items() if c not in lost), *(t for c, t in outputs.items() if c not in types)])
        if what not in self._changing:
            self._changing[what] = changes_rows(call(self._probe(types)))
        return {c: view[c] for c in view if c in wanted}, schema, self._changing[what]

    def _try(self, what: tuple, call: Callable[[DataFrame], DataFrame], part: dict[str, T.StructField]) -> T.StructType | str:
        """The schema of a step's result on these columns, or the name of one that it misses; asked once."""
        key = (*what, tuple((c, t.dataType.simpleString()) for c, t in part.items() if not c.startswith("__fit_")))
        if key not in self._asked:
            try:
                with _quiet():
                    self._asked[key] = call(self._probe(part)).schema
            except AnalysisException as e:
                self._asked[key] = (e.getMessageParameters() or {}).get("objectName", "?").strip("`")
        return self._asked[key]

    def _step(self, f: Callable, arguments: list[dict]) -> None:
        """Apply a step to every round."""
        for r, own in zip(self.places, arguments, strict=True):
            fitted = [v.column for v in own.values() if isinstance(v, _Fitted)]
            call = lambda df, own=own: f(df, self.series, **{k: C(v.column) if isinstance(v, _Fitted) else v for k, v in own.items()})
            inputs, schema, rows_change = self._ask(r, f, own, call, fitted)
            node = (f, frozen(own), tuple(inputs.items()))
            if rows_change:
                self._branch(r, call, node[:2])
                continue
            outputs = [s.name for s in schema if s.name not in fitted and (s.metadata.get(_MARK) != s.name)]
            if node not in r.frame.made:
                try:
                    r.frame.made[node] = self._compute(r, call, outputs, schema)
                except AnalysisException:  # it selects columns of its own choice
                    self._branch(r, call, node[:2])
                    continue
            now = r.view | r.frame.made[node]
            r.view = {c: now[c] for c in schema.names if c in now}

    def _compute(self, r: Round, call: Callable, outputs: list[str], schema: T.StructType) -> dict[str, str]:
        """Add a node's columns to the wide frame; the frame's other columns stay."""
        frame, before = r.frame, r.frame.schema
        # a name that stands for another round's content, or that the step replaces or drops, makes room
        hidden = {c: f"__hidden_{c}" for c in before if (c in r.view and r.view[c] != c) or c in outputs or (c in r.view and c not in schema.names)}
        shown = {c: hidden.get(o, o) for c, o in r.view.items() if o != c or c in hidden}
        df = frame.df.withColumnsRenamed(hidden) if hidden else frame.df
        out = call(df.selectExpr("*", *(f"`{o}` AS `{c}`" for c, o in shown.items())) if shown else df)
        with _quiet():
            if any(hidden.get(c, c) not in out.columns for c in before):
                raise AnalysisException("columns are lost")
        self.nodes += 1
        names = {c: f"__{self.nodes}_{c}" if c in before else c for c in outputs}
        out = out.drop(*(c for c in shown if c not in outputs))
        moved = {c: n for c, n in names.items() if c != n} | {h: c for c, h in hidden.items()}
        frame.df = out.withColumnsRenamed(moved) if moved else out
        for s in schema:
            if s.name in names:
                frame.schema[names[s.name]] = s
        return names

    def _branch(self, r: Round, call: Callable, step: tuple) -> None:
        """A step that changes rows: a frame of its own for the rounds with the same columns so far."""
        name = (r.frame.key, step, tuple(r.view.items()))
        if name not in self.frames:
            kept = [*self.keys, "datetime", "split"]
            own = r.frame.df.select(*kept, *(C(f"`{c}`").alias(n) for n, c in r.view.items()), *(e for e in r.fitted if e in r.frame.schema and e not in r.view))
            df = call(own)
            self.nodes += 1
            self.frames[name] = Frame(name, df, r.frame.bars, [c for c in df.columns if c not in kept], {f.name: f for f in df.schema})
        r.frame = self.frames[name]
        r.view = {c: c for c in r.frame.raw if c not in r.fitted}

    # fits

    def _fit(self, r: Round, fit: Callable, own: dict) -> str:
        """The column that will hold a fitted value."""
        if hasattr(fit, "many"):  # it names its columns
            inputs = {v: r.view[v] for v in own.values() if isinstance(v, str) and v in r.view}
        else:
            inputs, _, _ = self._ask(r, fit, own, lambda df: fit(df.where("split = 'train'"), self.keys, **own))
        key = (fit, frozen(own), tuple(inputs.items()))
        if key not in r.frame.made:
            self.nodes += 1
            r.frame.made[key] = {"value": f"__fit_{self.nodes}"}
            r.frame.waiting[key] = (f"__fit_{self.nodes}", fit, own, dict(r.view))
        return r.frame.made[key]["value"]

    def _join_fits(self) -> None:
        """Compute the fits that wait, those with `many` of the same columns in one aggregation, and join them by key."""
        for frame in self.frames.values():
            groups: dict[Any, list] = {}
            for name, fit, own, view in frame.waiting.values():
                groups.setdefault((fit, tuple(view.items())) if not hasattr(fit, "many") else (fit, "many"), []).append((name, fit, own, view))
            train = frame.df.where("split = 'train'")
            for (_, how), several in groups.items():
                fit = several[0][1]
                if how == "many":
                    got = fit.many(train, self.keys, {name: {k: view.get(v, v) if isinstance(v, str) else v for k, v in own.items()} for name, _, own, view in several})
                    frame.df = frame.df.join(got, list(self.keys), "left")
                    continue
                for name, _, own, view in several:
                    seen = train.select(*self.keys, "datetime", "split", *(C(f"`{c}`").alias(n) for n, c in view.items()))
                    frame.df = frame.df.join(fit(seen, self.keys, **own).withColumnRenamed("value", name), list(self.keys), "left")
            types = {f.name: f for f in frame.df.schema}
            frame.schema |= {name: types[name] for name, *_ in frame.waiting.values()}
            frame.waiting.clear()

    # rounds

    def _exploded(self, frame: Frame, of: list[int]) -> DataFrame:
        """round_id, keys, datetime, split, x, y of a frame's rounds; rows where a round has a null are left out."""
        target = self.manifest.target
        used = list(dict.fromkeys(itertools.chain.from_iterable(self.places[i].view.values() for i in of)))
        at = {c: k for k, c in enumerate(used)}
        rounds = json.dumps([{"round_id": i, "x": [at[self.places[i].view[c]] for c in self.features[i]], "y": at[self.places[i].view[target]]} for i in of])
        wide = frame.df.select(*self.keys, "datetime", "split", F.array(*(C(f"`{c}`").cast("double") for c in used)).alias("__v"))
        each = wide.select("*", F.explode(F.from_json(F.lit(rounds), "array<struct<round_id int, x array<int>, y int>>")).alias("__r"))
        out = each.select("__r.round_id", *self.keys, "datetime", "split", F.transform("__r.x", lambda i: F.get("__v", i)).alias("x"), F.get("__v", C("__r.y")).alias("y"))
        there = reduce(lambda a, b: a & b, (C(c).isNotNull() for c in (*self.keys, "datetime", "y")))
        return out.where(there & F.forall("x", lambda v: v.isNotNull()))

    def bars(self) -> DataFrame:
        """The test splits before features: base, keys, datetime and the bars' columns. base_of has each round's base."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.bars.where("split = 'test'").withColumn("base", F.lit(i)) for i, f in enumerate(self._bases.values())))


class _Fitted:
    """Stands for a fitted value's column in a step's arguments."""

    def __init__(self, column: str):
        self.column = column

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Fitted) and other.column == self.column

    def __hash__(self) -> int:
        return hash(self.column)


def staged_in(folder: str) -> Callable[[DataFrame], DataFrame]:
    """Writes a frame once as Parquet in a folder that all executors share, and reads it from there."""

    def write(df: DataFrame) -> DataFrame:
        path = f"{folder}/features-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return write
