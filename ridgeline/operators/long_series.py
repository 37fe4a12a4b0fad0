"""Windows over series too long for one task: segments of equal length with a halo, and state carried from segment to segment.

A window over a series is one task's work, however long the series is. Here rows get exact numbers first: they are counted by
buckets of time, the counts are summed up along each series (a small table), and rows are ranked within their bucket. A segment is then so many
consecutive numbers. Look-back windows run within segments that have the rows before them as a halo; what depends on all rows
before (sums, products, extremes, exponential means, last known values) runs within segments, the segments' ends are
combined along the series, and each segment takes the state before it. Every task holds one segment; no series is gathered.

Rows of one time (and series) aren't split over buckets: order by something finer where more than a segment of them is possible.
The order must tell a series' rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, odd, spoiled

C = F.col
#: Rows of a segment, and buckets of time for one segment's rows.
SEGMENT_ROWS, FINER = 1_000_000, 16
NUMBER, SEGMENT = "__number", "__segment"


def numbered(df: DataFrame, s: Series = Series(), name: str = NUMBER, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add each row's number within its series, from 0 in the series' order, without a window over a whole series."""
    time = C(s.order[0])
    time = F.unix_micros(time.cast("timestamp")) if df.schema[s.order[0]].dataType.typeName().startswith(("timestamp", "date")) else time.cast("long")
    low, high, n = df.agg(F.min(time), F.max(time), F.count("*")).first()
    width = max(1, (int(high or 0) - int(low or 0) + 1) // (FINER * max(1, -(-int(n) // segment_rows))))
    rows = df.withColumn("__bucket", F.floor((time - F.lit(int(low or 0))) / F.lit(width)))
    before = Window.partitionBy(*s.keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*s.keys, "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*s.keys, "__bucket").orderBy(*s.order)) - 1
    return _attached(rows, counts, (*s.keys, "__bucket")).withColumn(name, (C("__before") + place).cast("long")).drop("__bucket", "__before")


def _segmented(df: DataFrame, s: Series, segment_rows: int) -> tuple[DataFrame, Series]:
    return numbered(df, s, NUMBER, segment_rows).withColumn(SEGMENT, F.floor(C(NUMBER) / segment_rows)), Series((*s.keys, SEGMENT), (NUMBER,))


def rolling(df: DataFrame, f: Callable[[DataFrame, Series], DataFrame], s: Series = Series(), look_back: int = 0, look_ahead: int = 0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """f(df, series), as for short series, where f looks back and ahead at most so many rows (of windows on windows the sum).

    f must keep the rows that it gets. A segment is at least as long as the halo.
    """
    size = max(segment_rows, look_back, look_ahead, 1)
    rows, inner = _segmented(df, s, size)
    # a row goes to its own segment and, as halo, to the next or the one before
    near = F.array_distinct(F.array(C(SEGMENT), F.floor((C(NUMBER) + look_back) / size), F.floor((C(NUMBER) - look_ahead) / size)))
    copies = rows.withColumn("__own", C(SEGMENT)).withColumn(SEGMENT, F.explode(near)).where(f"{SEGMENT} >= 0")
    out = f(copies, inner).where(C("__own") == C(SEGMENT))
    return out.drop("__own", NUMBER, SEGMENT)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


#: Within a segment, along the segments' ends, and how the state before joins a segment's own.
_KINDS: dict[str, tuple[Callable, Callable, Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "product": (F.product, F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "last": (_last, _last, lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, wanted: Mapping[str, tuple[str, str]], s: Series = Series(), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Aggregates of all rows up to each one: {new column: (kind, column)}; kinds: sum, count, max, min, product, last (known value).

    As over the window form, nulls don't count, and rows before the first value have null (count: 0).
    """
    if unknown := {k for k, _ in wanted.values()} - _KINDS.keys():
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    rows, inner = _segmented(df, s, segment_rows)
    rows = rows.withColumns({f"__r_{new}": _KINDS[kind][0](C(c)).over(inner.so_far) for new, (kind, c) in wanted.items()})
    ends = rows.groupBy(*s.keys, SEGMENT).agg(*(F.max_by(f"__r_{new}", NUMBER).alias(f"__e_{new}") for new in wanted))
    before = Window.partitionBy(*s.keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select(*s.keys, SEGMENT, *(_KINDS[kind][1](C(f"__e_{new}")).over(before).alias(f"__b_{new}") for new, (kind, _) in wanted.items()))
    out = _attached(rows, state, (*s.keys, SEGMENT))
    out = out.withColumns({new: _KINDS[kind][2](C(f"__b_{new}"), C(f"__r_{new}")) for new, (kind, _) in wanted.items()})
    return out.drop(NUMBER, SEGMENT, *(f"__{x}_{new}" for new in wanted for x in "rb"))


def _attached(rows: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """The columns of a table that has one row for each value of `on`, nulls among them."""
    small = small.withColumnsRenamed({c: f"__on{i}" for i, c in enumerate(on)})
    same = [C(c).eqNullSafe(C(f"__on{i}")) for i, c in enumerate(on)]
    return rows.join(small.hint("merge"), same, "left").drop(*(f"__on{i}" for i in range(len(on))))


def ewm(df: DataFrame, wanted: Mapping[str, tuple[str, float]], s: Series = Series(), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Exponential means as Series.with_ewm, {new column: (column, alpha)}.

    Within a segment the mean starts from nothing; what comes before it is the mean at the end of the segment before, which fades by 1 - alpha
    with each row. The ends follow the same recursion, with the fading of a whole segment.
    """
    rows, inner = _segmented(df, s, segment_rows)
    rows = inner.with_decayed(rows, {f"__r_{new}": (c, alpha) for new, (c, alpha) in wanted.items()}, C(SEGMENT) == 0)
    rows = rows.withColumns({f"__m_{new}": F.bit_or(odd(c)).over(inner.so_far) for new, (c, _) in wanted.items()})
    ends = rows.groupBy(*s.keys, SEGMENT).agg(*(F.max_by(f"__{x}_{new}", NUMBER).alias(f"__{x}_{new}") for new in wanted for x in "rm"))
    along = Series(s.keys, (SEGMENT,))
    # y = end + fade * y before: such a recursion again, of end / (1 - fade)
    fade = {new: (1.0 - alpha) ** segment_rows for new, (_, alpha) in wanted.items()}
    ends = ends.withColumns({f"__r_{new}": C(f"__r_{new}") / (1.0 - fade[new]) for new in wanted})
    ends = along.with_decayed(ends, {f"__b_{new}": (f"__r_{new}", 1.0 - fade[new]) for new in wanted}, F.lit(False))
    before = along.window.rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select(*s.keys, SEGMENT, *(F.lag(f"__b_{new}").over(along.window).alias(f"__b_{new}") for new in wanted), *(F.bit_or(f"__m_{new}").over(before).alias(f"__n_{new}") for new in wanted))
    out, place = _attached(rows, state, (*s.keys, SEGMENT)), C(NUMBER) - C(SEGMENT) * segment_rows + 1
    own = {}
    for new, (c, alpha) in wanted.items():
        y = C(f"__r_{new}") + F.coalesce(C(f"__b_{new}"), F.lit(0.0)) * F.pow(F.lit(1.0 - alpha), place)
        own[new] = F.when(C(c).isNotNull(), spoiled(y, C(f"__m_{new}").bitwiseOR(F.coalesce(C(f"__n_{new}"), F.lit(0)))))
    return out.withColumns(own).drop(NUMBER, SEGMENT, *(f"__{x}_{new}" for new in wanted for x in "rmbn"))
