"""The null, NaN, ordering and quantile rules."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series, clip, drop_null_rows, fdiv, q_exact, q_linear, q_nearest, q_ranked

S = Series(("g",), ("t",))


def frame(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "g string, t int, x double")


def test_rolling_waits_for_a_full_window(spark):
    got = [r[0] for r in frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]).select(S.mean("x", 3).alias("m"), "t").orderBy("t").collect()]
    assert got == [None, None, None, None, None, 5.0]


def test_division_is_ieee(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (6.0, 3.0)], "a double, b double").select(fdiv("a", "b")).collect()
    got = [r[0] for r in rows]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 2.0


def test_clip_and_drop_keep_nan(spark):
    df = frame(spark, [None, float("nan"), 5.0, -5.0])
    got = [r[0] for r in df.select(clip(F.col("x"), 0, 1), "t").orderBy("t").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [1.0, 0.0]
    assert drop_null_rows(df, ["x"]).count() == 3


def test_three_quantiles(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0])
    assert df.agg(q_nearest("x", 0.5), q_exact("x", 0.5), q_linear("x", 0.5)).first()[:] == (3.0, 3.0, 2.5)
    assert q_ranked(df, ["g"], "x", {"a": 0.5, "b": 0.9}).first()[:] == ("a", 3.0, 4.0)
    assert q_ranked(df, ["g"], "x", {"a": 0.5}, "exact").first()["a"] == 3.0


@pytest.mark.parametrize("alpha", [0.05, 2 / 13, 0.9, 1.0])
def test_exponential_mean(spark, alpha):
    values = [math.sin(i) * 10 + i for i in range(3_000)]  # several blocks of every alpha
    expected = pd.Series(values).ewm(alpha=alpha, adjust=False).mean()
    found = [r["y"] for r in S.with_ewm(frame(spark, values), {"y": ("x", alpha)}).orderBy("t").collect()]
    assert found == pytest.approx(expected.tolist(), rel=1e-12)
    holes = [None if i % 50 == 7 else v for i, v in enumerate(values[:200])]
    assert [r["y"] is None for r in S.with_ewm(frame(spark, holes), {"y": ("x", alpha)}).orderBy("t").collect()] == [v is None for v in holes]
