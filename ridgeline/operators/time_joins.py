"""Joins by time: the nearest row before or after (as-of), and rows within intervals. Neither makes all pairs of a key.

As-of: both sides are put together, tagged and ordered by time; each left row takes the last (or next) right row.
One window per key, or segments of bounded size with the last known row carried from one to the next, where a key's rows may be
too many for a task. Intervals: each one is entered into the few buckets of time that it meets on a level of buckets about as long as itself, and a row looks
into its bucket of each level, so that long intervals aren't copied into many short buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series
from ridgeline.operators import long_series

C = F.col
DIRECTIONS = ("backward", "forward", "nearest")


def micros(df: DataFrame, c: str):
    """A time or number as a long."""
    return F.unix_micros(C(c).cast("timestamp")) if df.schema[c].dataType.typeName().startswith(("timestamp", "date")) else C(c).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, on: str = "datetime", keys: Sequence[str] = ("series",), direction: str = "backward", tolerance: int | None = None, exact: bool = True, columns: Sequence[str] | None = None, suffix: str = "_right", segment_rows: int | None = None
) -> DataFrame:
    """All left rows, each with the columns (default: all) of the right row of its key nearest in time; null where there is none.

    direction: backward (the last one before), forward (the next one) or nearest (of equal distances the one before). exact: rows of the very same time
    count. tolerance: the largest distance, in microseconds for times. Of right rows of one key and time the one with the greatest
    values, in the order of the columns, counts. Left columns keep their names; right columns that clash get the suffix. Null times and null keys have no partner.
    segment_rows: rows of a segment; None: a window per key.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    keys = list(keys)
    taken = [c for c in (right.columns if columns is None else columns) if c not in keys]
    named = {c: c if c not in left.columns else f"{c}{suffix}" for c in taken}
    has = reduce(lambda a, b: a & b, (C(c).isNotNull() for c in (*keys, on)))
    matched, alone = left.where(has), left.where(~has)
    ours = matched.select(*(C(c).alias(f"__key{i}") for i, c in enumerate(keys)), micros(left, on).alias("__t"), F.lit(1).alias("__tag"), F.struct(*left.columns).alias("__left"), F.xxhash64(*left.columns).alias("__order"))
    theirs = right.where(has).select(*(C(c).alias(f"__key{i}") for i, c in enumerate(keys)), micros(right, on).alias("__t"), F.struct(*(C(c).alias(f"v{i}") for i, c in enumerate(taken))).alias("__right"))
    theirs = theirs.groupBy(*(f"__key{i}" for i in range(len(keys))), "__t").agg(F.max("__right").alias("__right"))
    own_keys = tuple(f"__key{i}" for i in range(len(keys)))
    wanted = ("backward", "forward") if direction == "nearest" else (direction,)
    both = None
    for way in wanted:
        # forward is backward in mirrored time; where equal times count, right rows come first
        sign, tag = (1 if way == "backward" else -1), (0 if exact else 2)
        mirrored = theirs.select(*own_keys, (C("__t") * sign).alias("__at"), F.lit(tag).alias("__tag"), F.lit(None).cast(ours.schema["__left"].dataType).alias("__left"), F.lit(0).cast("long").alias("__order"), F.struct(C("__t").alias("t"), C("__right").alias("r")).alias("__seen"))
        rows = (ours if both is None else both).withColumn("__at", C("__t") * sign)
        carried = [c for c in ("__seen_backward",) if c in rows.columns]
        rows = rows.select(*own_keys, "__at", "__tag", "__left", "__order", F.lit(None).cast(mirrored.schema["__seen"].dataType).alias("__seen"), "__t", *carried)
        union = rows.unionByName(mirrored, allowMissingColumns=True)
        s = Series(own_keys, ("__at", "__tag", "__order"))
        if segment_rows is None:
            union = union.withColumn("__known", F.last("__seen", True).over(s.so_far))
        else:
            union = long_series.running(union, {"__known": ("last", "__seen")}, s, segment_rows)
        both = union.where("__tag = 1").withColumnRenamed("__known", f"__seen_{way}").drop("__at", "__seen")
    near = {w: F.when(F.abs(C(f"__seen_{w}.t") - C("__t")) <= (tolerance if tolerance is not None else (1 << 62)), C(f"__seen_{w}")) for w in wanted}
    if direction == "nearest":
        before, after = near["backward"], near["forward"]
        found = F.when(before.isNull() | (after["t"] - C("__t") < C("__t") - before["t"]), F.coalesce(after, before)).otherwise(before)
    else:
        found = near[direction]
    out = both.withColumn("__found", found).select("__left.*", *(C(f"__found.r.v{i}").alias(named[c]) for i, c in enumerate(taken)))
    return out.unionByName(alone, allowMissingColumns=True)


def interval_join(rows: DataFrame, intervals: DataFrame, on: str = "datetime", start: str = "start", end: str = "end", keys: Sequence[str] = ("series",), how: str = "inner", closed: str = "left", suffix: str = "_right") -> DataFrame:
    """Rows with each interval of their key that they lie in: start <= time < end (closed left), or <= end (closed both).

    how: inner, or left (rows in no interval stay, with nulls). Empty intervals and nulls match nothing. Interval columns that clash
    get the suffix. An interval meets at most five buckets of its level; levels grow by four, and only those in use are looked into.
    """
    if how not in ("inner", "left") or closed not in ("left", "both"):
        raise ValueError("how must be inner or left, closed left or both")
    keys = list(keys)
    named = {c: c if c not in rows.columns else f"{c}{suffix}" for c in intervals.columns if c not in keys}
    last = micros(intervals, end) - (1 if closed == "left" else 0)
    held = intervals.select(*(C(c).alias(f"__key{i}") for i, c in enumerate(keys)), micros(intervals, start).alias("__a"), last.alias("__b"), F.struct(*named).alias("__i")).where("__a <= __b")
    level = F.ceil(F.log2((C("__b") - C("__a") + 1).cast("double")) / 2).cast("int")
    held = held.withColumn("__level", level)
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # at most 32
    width = F.pow(F.lit(4.0), C("__level")).cast("long")
    cells = held.withColumn("__cell", F.explode(F.sequence(F.floor(C("__a") / width), F.floor(C("__b") / width))))
    looked = rows.withColumn("__t", micros(rows, on)).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__cell", F.floor(C("__t") / width))
    same = [C(c) == C(f"__key{i}") for i, c in enumerate(keys)]
    cells = cells.withColumnsRenamed({"__level": "__level2", "__cell": "__cell2"})
    met = looked.join(cells, [*same, C("__level") == C("__level2"), C("__cell") == C("__cell2"), C("__t") >= C("__a"), C("__t") <= C("__b")])
    out = met.select(*rows.columns, *(C(f"__i.{c}").alias(n) for c, n in named.items()))
    if how == "inner":
        return out
    # rows without an interval: those whose values are in no pair
    seen = met.select(*(C(c).alias(f"__seen{i}") for i, c in enumerate(rows.columns))).distinct()
    same = [C(c).eqNullSafe(C(f"__seen{i}")) for i, c in enumerate(rows.columns)]
    return out.unionByName(rows.join(seen, same, "left_anti"), allowMissingColumns=True)
