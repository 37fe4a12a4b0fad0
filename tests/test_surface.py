"""Table functions and views in SQL against the operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ridgeline.operators import evaluation as ev
from ridgeline.operators.bars import compute_bars
from ridgeline.plans import surface


@pytest.fixture(scope="module")
def hourly(spark):
    r, rows = random.Random(3), []
    for name, n in (("a", 60), ("b", 25), ("one", 1)):
        for i in range(n):
            p = r.uniform(90, 110)
            rows.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), p, p + 1, p - 1, p + 0.5, 100.0 if i == 0 else r.uniform(1, 9), r.randint(1, 20), r.uniform(100, 900), r.random(), 1.0, 2.0, p))
    surface.register(spark)
    df = spark.createDataFrame(rows, "series string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, no_of_trades long, liquidity_sum double, maker_ratio double, maker_volume double, maker_liquidity double, mean double")
    df.createOrReplaceTempView("surface_hourly")
    return df


@pytest.mark.parametrize("kind", ["volume", "trade", "liquidity"])
def test_bars_in_sql(spark, hourly, kind):
    got = {(x["series"], x["datetime"]): x for x in spark.sql(f"SELECT * FROM activity_bars(TABLE(surface_hourly) PARTITION BY series ORDER BY (datetime), 50D, '{kind}')").collect()}
    want = {(x["series"], x["datetime"]): x for x in compute_bars(hourly, kind, 50).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    for k, x in want.items():
        assert all(got[k][c] == (pytest.approx(v) if isinstance(v, float | int) else v) for c, v in x.asDict().items())
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT * FROM activity_bars(TABLE(surface_hourly) PARTITION BY series ORDER BY (datetime), 0D, 'volume')").collect()


def test_backtests_in_sql(spark, hourly):
    df = hourly.selectExpr("series AS round_id", "datetime", "CAST(hour(datetime) % 2 AS INT) AS prediction", "open", "close")
    df.createOrReplaceTempView("surface_predictions")
    got = spark.sql("SELECT * FROM sequential_backtest(TABLE(surface_predictions) PARTITION BY round_id ORDER BY (datetime), 30000D, 0.001D)")
    assert sorted(got.collect()) == sorted(ev.sequential_backtest(df).collect())


def test_klines_as_a_view(spark):
    trades = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), 1.0 + i, 1.0, True) for i in range(9)], "series string, trade_id long, datetime timestamp_ntz, price double, quantity double, is_buyer_maker boolean")
    surface.kline_view(spark, trades, "surface_klines")
    assert [r[0] for r in spark.sql("SELECT close FROM surface_klines ORDER BY datetime").collect()] == [3.0, 6.0, 9.0]
