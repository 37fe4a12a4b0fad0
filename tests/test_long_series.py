"""Segments with halos and carried state against windows over whole series."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series
from ridgeline.operators import features as ft
from ridgeline.operators import indicators as ind
from ridgeline.operators import long_series as ls

S = Series(("series",), ("datetime", "id"))


@pytest.fixture(scope="module")
def ticks(spark):
    r, rows = random.Random(4), []
    for name, n in (("a", 700), ("b", 45), (None, 12)):
        at, price = dt.datetime(2024, 1, 1), 100.0
        for i in range(n):
            at += dt.timedelta(seconds=r.choice([0, 0, 1, 2, 4000 if i % 97 == 0 else 3]))  # ties, bursts and gaps
            price *= 1 + r.gauss(0, 0.01)
            rows.append((name, at, i, price, price * 1.01, price * 0.99, None if r.random() < 0.1 else r.uniform(1, 9)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "series string, datetime timestamp_ntz, id long, close double, high double, low double, volume double").cache()


def both(spark, a, b):
    key = lambda r: (r["series"] or "", r["datetime"], r["id"])
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert a.columns == b.columns and len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        for c in a.columns:
            u, v = x[c], y[c]
            same = u == v or (isinstance(u, float) and isinstance(v, float) and (math.isnan(u) and math.isnan(v) or u == pytest.approx(v, rel=1e-9, abs=1e-12)))
            assert same, (c, x, y)


@pytest.mark.parametrize("segment_rows", [1, 37, 10_000])
def test_numbers(spark, ticks, segment_rows):
    want = ticks.withColumn("n", F.row_number().over(S.window).cast("long") - 1)
    both(spark, ls.numbered(ticks, S, "n", segment_rows), want)


@pytest.mark.parametrize("segment_rows", [20, 64, 10_000])
def test_halos_equal_whole_windows(spark, ticks, segment_rows):
    def steps(df, s):
        df = ft.atr_sma(ind.bollinger_bands(ind.roc(df, s, period=12), s, window=10), s, period=9)
        return ft.forward_breakout_target(ind.sma_deviation_std(df, s, period=10, window=8), s, forward_periods=6, threshold=0.01, shift=-1)

    both(spark, ls.rolling(ticks, steps, S, look_back=20, look_ahead=8, segment_rows=segment_rows), steps(ticks, S))
    assert ls.rolling(ticks.limit(0), steps, S, 20, 8).count() == 0


def test_a_short_halo_is_seen(ticks):
    mean = lambda df, s: ind.sma(df, s, column="close", period=10)
    short = ls.rolling(ticks, mean, S, look_back=5, segment_rows=20)
    assert short.where("close_sma_10 IS NULL").count() > mean(ticks, S).where("close_sma_10 IS NULL").count()


@pytest.mark.parametrize("segment_rows", [7, 50, 10_000])
def test_running_state_equals_whole_windows(spark, ticks, segment_rows):
    df = ticks.withColumn("gross", 1 + F.coalesce(F.col("close") / F.lag("close").over(S.window) - 1, F.lit(0.0)))
    w = S.window.rowsBetween(Window.unboundedPreceding, 0)
    wanted = {"sum": ("sum", "volume"), "n": ("count", "volume"), "top": ("max", "high"), "low_so_far": ("min", "low"), "equity": ("product", "gross"), "known": ("last", "volume")}
    want = df.withColumns({"sum": F.sum("volume").over(w), "n": F.count("volume").over(w), "top": F.max("high").over(w), "low_so_far": F.min("low").over(w), "equity": F.product("gross").over(w), "known": F.last("volume", True).over(w)})
    both(spark, ls.running(df, wanted, S, segment_rows), want)
    with pytest.raises(ValueError):
        ls.running(df, {"x": ("median", "close")}, S)


def recursion(values, alpha):
    y, out = None, []
    for x in values:
        if x is None:
            y = y * (1 - alpha) if y is not None else 0.0
        else:
            y = x if not out else alpha * x + (1 - alpha) * y
        out.append(None if x is None else y)
    return out


@pytest.mark.parametrize("segment_rows", [5, 50, 10_000])
def test_exponential_means_equal_the_recursion(spark, ticks, segment_rows):
    rows = {}
    for r in ticks.collect():
        rows.setdefault(r["series"], []).append(r)
    for alpha in (0.5, 0.02):
        got = {(r["series"], r["id"]): r for r in ls.ewm(ticks, {"y": ("close", alpha), "v": ("volume", alpha)}, S, segment_rows).collect()}
        for name, own in rows.items():
            own = sorted(own, key=lambda r: (r["datetime"], r["id"]))
            for new, c in (("y", "close"), ("v", "volume")):
                for r, want in zip(own, recursion([r[c] for r in own], alpha), strict=True):
                    have = got[name, r["id"]][new]
                    assert have is None if want is None else have == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_exponential_means_stay_spoiled(spark, bad):
    values = [1.0, 2.0, 3.0] + [bad] + [4.0] * 300
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series string, datetime long, x double")
    s = Series()
    for out in (s.with_ewm(df, {"y": ("x", 0.5)}), ls.ewm(df, {"y": ("x", 0.5)}, s, 40)):
        y = [r["y"] for r in out.orderBy("datetime").collect()]
        assert y[:3] == pytest.approx([1.0, 1.5, 2.25])
        assert all(math.isnan(v) if math.isnan(bad) else v == bad for v in y[3:])
    both_signs = df.withColumn("x", F.when(F.col("datetime") == 200, float("-inf")).otherwise(F.col("x")))
    assert all(math.isnan(r["y"]) for r in ls.ewm(both_signs, {"y": ("x", 0.5)}, s, 40).where("datetime >= 200").collect())
