"""Hand-made cases for scans, spans, splits, scalers, metrics, backtests, sweeps and streams."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series
from ridgeline.operators import evaluation as ev
from ridgeline.operators import features, models, pools, prep, spans, sweep
from ridgeline.operators.bars import bar_groups, compute_bars
from ridgeline.operators.klines import klines
from ridgeline.operators.ledger import Account, run_backtest
from ridgeline.sources import trades as tr
from ridgeline.streaming import klines as stream


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


def test_bar_groups_drop_the_overshoot(spark):
    df = spark.createDataFrame([("a", at(i), v) for i, v in enumerate([4.0, 6.0, 25.0, 3.0, 6.0, 1.0, 2.0])], "series string, datetime timestamp_ntz, volume double")
    assert [r["bar_group"] for r in bar_groups(df, 10, "volume").orderBy("datetime").collect()] == [0, 0, 1, 2, 2, 2, 3]


def test_bars_need_a_threshold(spark):
    df = spark.createDataFrame([("a", at(0), 1.0)], "series string, datetime timestamp_ntz, volume double")
    assert compute_bars(df, "base") is df
    with pytest.raises(ValueError):
        compute_bars(df, "volume")


def test_spans(spark):
    rows = spark.createDataFrame([("a", i) for i in range(6)], "series string, i long")
    lines = spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("a", -5, -2), ("a", 4, 9)], "series string, start_idx long, end_idx long")
    get = lambda f, name, **k: [r[name] for r in f(rows, lines, **k).orderBy("i").collect()]
    assert get(spans.active_lines, "active_lines") == [1, 1, 2, 1, 2, 1]
    assert get(spans.active_quantile_count, "active_quantile_count") == [1, 1, 1, 1, 1, 1]
    assert get(spans.hours_since_big_move, "hours_since_big_move", lookback=10) == [2, 3, 4, 1, 2, 1]
    assert get(spans.hours_since_quantile_line, "hours_since_quantile_line", lookback=10) == [2, 3, 0, 1, 0, 1]
    assert get(spans.quantile_line_density, "quantile_line_density_48h", lookback=2) == [1, 0, 1, 1, 2, 1]


def test_split_sizes_and_slices(spark):
    df = spark.createDataFrame([("a", at(i)) for i in range(11)], "series string, datetime timestamp_ntz")
    for split in (prep.split_sequential(df), prep.split_random(df, seed=1)):
        assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 8, "val": 1, "test": 2}
    rows = prep.row_index(df)
    one, two = (prep.random_slice(rows, 4, 11, seed=s).select("i").orderBy("i").collect() for s in (1, 1))
    assert one == two and len(one) == 4
    with pytest.raises(ValueError):
        prep.random_slice(rows, 12, 11)


def test_scaler_round_trip(spark):
    df = prep.split_sequential(spark.createDataFrame([("a", at(i), float(i), float(i * i)) for i in range(22)], "series string, datetime timestamp_ntz, close double, volume double"))
    scaler = prep.Scaler(["close", "volume"], prep.build_rules({"close": "divide_100"}))
    fitted = scaler.fit(df)
    back = scaler.inverse(scaler.transform(df, fitted), fitted).orderBy("datetime").collect()
    assert [r["volume"] for r in back] == pytest.approx([i * i for i in range(22)], abs=1e-6) and scaler.rule["close"] == "divide_100"


def test_lags_are_checked(spark):
    df = spark.createDataFrame([("a", at(0), 1.0)], "series string, datetime timestamp_ntz, close double")
    with pytest.raises(ValueError):
        features.lag_range_cols(df, cols="close")
    with pytest.raises(ValueError):
        features.momentum_confirmation(df, short_period=3, long_period=3)


def test_auc_equals_pairs(spark):
    rng = random.Random(0)
    rows = [(0, rng.randint(0, 1), rng.randint(0, 5) / 5) for _ in range(80)]
    pairs = [(p > n) + (p == n) / 2 for _, y, p in rows if y for _, z, n in rows if not z]
    got = ev.auc(spark.createDataFrame(rows, "round_id int, actual int, proba double"), "actual", "proba").first()["auc"]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_snapshot_costs_each_run(spark):
    rows = [(0, at(i), p, o, c, c - o) for i, (p, o, c) in enumerate([(0, 10.0, 10.0), (1, 10.0, 11.0), (1, 11.0, 12.0), (0, 12.0, 12.0), (1, 12.0, 12.0)])]
    got = ev.backtest_snapshot(spark.createDataFrame(rows, "round_id int, datetime timestamp_ntz, prediction int, open double, close double, price_change double")).first()
    assert got["total_return_net_pct"] == pytest.approx((1.1 * (12 / 11 - 0.002) * (1 - 0.002) - 1) * 100) and got["trades_count"] == 3


def test_ledger_against_its_own_sums():
    rng, account = random.Random(42), Account(1_000_000)
    bought = sold = 0.0
    for _ in range(2_000):
        price, amount = rng.uniform(30_000, 70_000), rng.uniform(1, 500)
        if rng.random() < 0.6 and account.usdt > amount:
            account.update("buy", amount, price)
            bought += account.rows[-1]["btc"]
        elif account.long * price > amount:
            account.update("sell", amount, price)
            sold += account.rows[-1]["btc"]
    assert account.long == pytest.approx(bought - sold)
    for bad in (("buy", -1, 5), ("sell", 1e9, 1), ("cover", 1, 1), ("fly", 1, 1), ("buy", 1, 0)):
        with pytest.raises(ValueError):
            account.update(*bad)


def test_sequential_backtest_signs():
    assert run_backtest([1], [100.0], [110.0])["pnl"] > 0 > run_backtest([1], [100.0], [90.0])["pnl"]
    assert run_backtest([0, 0], [1.0, 1.0], [2.0, 2.0])["pnl"] == 0
    with pytest.raises(ValueError):
        run_backtest([1], [1.0, 2.0], [1.0])


def test_param_space_is_lazy_and_distinct():
    space = sweep.ParamSpace({f"p{i}": list(range(8)) for i in range(15)}, 10_000, seed=1)
    got = {tuple(p.values()) for p in space}
    assert space.size == 8**15 and len(got) == 10_000 and space.generate() is None
    assert len(list(sweep.ParamSpace({"a": [1, 2], "b": [3]}, 99))) == 2
    assert sweep.resolve("_a", {"a": 3}) == 3 and sweep.resolve("x_{a}", {"a": 3}) == "x_3" and sweep.resolve("y", {"a": 3}) == "y"


def test_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert ((models.fit_logistic(x, y)(x) > 0.5) == y).mean() > 0.95
    z = x[:, 0] * 2
    assert np.mean((models.fit_boosted(x, z, x, z, learning_rate=0.3, n_estimators=80)(x) - z) ** 2) < 0.2 * z.var()


def test_majority_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(1, "t", 0.0), (2, "t", 1.0)], "round_id int, datetime string, prediction double")
    assert pools.aggregate_predictions(df, "majority").first()["prediction"] == 0.0
    assert pools.aggregate_predictions(df, "other", threshold=0.5).first()["prediction"] == 1


@pytest.mark.parametrize("quantiles", [True, False])
def test_stream_equals_batch(spark, tmp_path, quantiles):
    rows = [("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float(i % 9 + 1), float(i % 4 + 1), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, trade_id long, datetime timestamp, price double, quantity double, is_buyer_maker boolean")
    for part in range(2):  # the second run starts from the first one's checkpoint
        df.where((F.col("trade_id") >= 100) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frame = stream.stream_klines(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), quantiles=quantiles)
        stream.start(frame, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(240)
    got = {r["datetime"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {r["datetime"]: r.asDict() for r in klines(df, quantiles="counted" if quantiles else "none").collect()}
    assert len(got) >= 20 and got.keys() <= expected.keys()  # the last bucket is still open
    for t, row in got.items():
        assert row.keys() == expected[t].keys() and all(row[c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in expected[t].items()), (row, expected[t])


def test_quantiles_of_klines_agree(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(1000)]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randint(0, 600)), r.choice([None, 1.0, 2.0, 2.5, 7.0, 9.0]), r.uniform(1, 5), r.choice([True, False, None])) for _ in range(900)]
    rows += [("lost", i, dt.datetime(2024, 1, 1), None, 1.0, True) for i in range(3)]
    df = spark.createDataFrame(rows, "series string, trade_id long, datetime timestamp_ntz, price double, quantity double, is_buyer_maker boolean").dropDuplicates(["trade_id", "series"])
    key = lambda x: (x["series"] or "", x["datetime"])
    counted, listed = (sorted(klines(df, 3600, quantiles=q).collect(), key=key) for q in ("counted", "list"))
    assert len(counted) == len(listed) > 20
    for x, y in zip(counted, listed, strict=True):
        assert all(x[c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v) for c, v in y.asDict().items()), (x, y)
    with pytest.raises(ValueError):
        klines(df, quantiles="guessed")


def test_trade_selection(spark):
    df = spark.createDataFrame([("a", i, at(i * 100), i) for i in range(20)], "series string, trade_id long, datetime timestamp_ntz, timestamp long")
    assert tr.select_trades(df, month_year=(1, 2024)).count() == 8
    assert [r["trade_id"] for r in tr.select_trades(df, n_rows=2).collect()] == [19, 18]
    assert tr.select_trades(df, n_random=5).collect() == tr.select_trades(df.repartition(3), n_random=5).collect()
    with pytest.raises(ValueError):
        tr.select_trades(df)
    assert Series().keys == ("series",) and F is not None
