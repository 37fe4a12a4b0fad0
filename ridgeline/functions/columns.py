"""Column builders with the engine's null, NaN and ordering rules.

- A rolling aggregate over n rows is null until n non-null values are in it.
- Division follows IEEE 754: x/0 is an infinity, 0/0 is NaN; nothing raises.
- Clipping passes null and NaN through; dropping null rows keeps NaN.
- Windows always count ROWS within (keys) ordered by (order): never file order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Series:
    """Which rows belong together, and their order."""

    keys: tuple[str, ...] = ("series",)
    order: tuple[str, ...] = ("datetime",)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(1 - n, 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        """The value n rows before; n below zero looks ahead."""
        return F.lag(c, n).over(self.window) if n >= 0 else F.lead(c, -n).over(self.window)

    def roll(self, f: Callable[[Column], Column], c: str | Column, n: int, least: int | None = None) -> Column:
        c = col(c)
        least = n if least is None else least
        return F.when(F.count(c).over(self.last(n)) >= least, f(c).over(self.last(n)))

    def mean(self, c: str | Column, n: int) -> Column:
        return self.roll(F.avg, c, n)

    def std(self, c: str | Column, n: int) -> Column:
        return self.roll(F.stddev_samp, c, n)

    def change(self, c: str | Column, n: int = 1) -> Column:
        return fdiv(col(c), self.lag(c, n)) - 1

    def with_ewm(self, df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
        """Exponential means, y0 = x0 and y = alpha * x + (1 - alpha) * y before: {new column: (column, alpha)}.

        A null value gives null and weighs nothing. As the recursion has it, nothing is finite again after a NaN (or
        infinities of both signs), and after an infinity all is infinite.
        """
        own = {new: f"__y{k}" for k, new in enumerate(columns)}
        marks = {new: f"__m{k}" for k, new in enumerate(columns)}
        out = self.with_decayed(df, {own[new]: (c, alpha) for new, (c, alpha) in columns.items()}).withColumns({marks[new]: F.bit_or(odd(c)).over(self.so_far) for new, (c, _) in columns.items()})
        return out.withColumns({new: F.when(F.col(c).isNotNull(), spoiled(F.col(own[new]), F.col(marks[new]))) for new, (c, _) in columns.items()}).drop(*own.values(), *marks.values())

    def with_decayed(self, df: DataFrame, columns: dict[str, tuple[str, float]], seeded: Column | None = None) -> DataFrame:
        """The recursion y = alpha * x + (1 - alpha) * y before, from 0; null, NaN and infinite values count as 0.

        Where `seeded` holds (default: everywhere) the first row of a series weighs 1. Rows are cut into blocks of so many
        that a weight falls below 1e-17 in one. Within a block the mean is one running sum of scaled values, and the block
        before adds its last mean: linear in the rows, all in windows over the same partitions.
        """
        df, own = df.withColumn("__i", F.row_number().over(self.window) - 1), ["__i"]
        first = F.col("__i") == 0 if seeded is None else (F.col("__i") == 0) & seeded
        for k, (new, (c, alpha)) in enumerate(columns.items()):
            value = F.when(odd(c) == 0, F.col(c).cast("double"))
            if alpha >= 1:
                df = df.withColumn(new, F.coalesce(value, F.lit(0.0)))
                continue
            q, n = 1 - alpha, math.ceil(math.log(1e-17) / math.log(1 - alpha))
            place, (block, term, local, end) = F.col("__i") % n, (f"__{x}{k}" for x in "btle")
            within = Window.partitionBy(*self.keys, block).orderBy(*self.order)
            df = df.withColumns({block: F.floor(F.col("__i") / n), term: F.when(first, 1.0).otherwise(alpha) * value * F.pow(F.lit(1 / q), place)})
            df = df.withColumn(local, F.coalesce(F.sum(term).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) * F.pow(F.lit(q), place))
            df = df.withColumn(end, F.last(local).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            df = df.withColumn(new, F.col(local) + F.coalesce(F.lag(end, n).over(self.window), F.lit(0.0)) * F.pow(F.lit(q), place + 1))
            own += [block, term, local, end]
        return df.drop(*own)


def odd(c: str | Column) -> Column:
    """4 for NaN, 1 and 2 for the infinities, 0 for other values and null."""
    c = col(c).cast("double")
    return F.when(F.isnan(c), 4).when(c == INF, 1).when(c == -INF, 2).otherwise(0)


def spoiled(y: Column, marks: Column) -> Column:
    """A sum's value after all that odd() marked in the rows before."""
    return F.when(marks >= 3, NAN).when(marks == 1, INF).when(marks == 2, -INF).otherwise(y)


def fdiv(a: str | Column, b: str | Column) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), None).when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, lo if isinstance(lo, Column) else F.lit(float(lo))), hi if isinstance(hi, Column) else F.lit(float(hi))))


def flag(c: Column) -> Column:
    """1 or 0; null stays null."""
    return c.cast("int")


def finite(c: str | Column) -> Column:
    """Null instead of NaN and infinities, for presentation."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null; unlike dropna() this keeps NaN."""
    for c in columns or df.columns:
        df = df.where(F.col(c).isNotNull())
    return df


def q_nearest(c: str | Column, q: float) -> Column:
    """Aggregate: the sorted value at index round((n - 1) * q), half away from zero."""
    c = col(c)
    xs = F.array_sort(F.collect_list(c))
    return F.get(xs, F.floor((F.size(xs) - 1) * q + 0.5).cast("int"))


def q_exact(c: str | Column, q: float) -> Column:
    """Aggregate: the sorted value at index floor(q * n)."""
    c = col(c)
    xs = F.array_sort(F.collect_list(c))
    return F.get(xs, F.least(F.floor(F.size(xs) * q), F.size(xs) - 1).cast("int"))


def q_linear(c: str | Column, q: float) -> Column:
    """Aggregate: linear interpolation."""
    return F.percentile(col(c), q)


def q_ranked(df: DataFrame, keys: list[str], c: str, qs: dict[str, float], rule: str = "nearest") -> DataFrame:
    """Exact quantiles of large groups by ranks (a sort with spill) instead of a gathered list: one row per group."""
    w = Window.partitionBy(*keys)
    n, k = F.count(c).over(w), F.row_number().over(w.orderBy(c)) - 1
    ranked = df.where(F.col(c).isNotNull()).select(*keys, c, n.alias("__n"), k.alias("__k"))
    at = {name: F.floor((F.col("__n") - 1) * q + 0.5) if rule == "nearest" else F.least(F.floor(F.col("__n") * q), F.col("__n") - 1) for name, q in qs.items()}
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("__k") == i, F.col(c))).alias(name) for name, i in at.items()))
