"""Manifests, the experiment loop, models and specs on small made-up series."""

from __future__ import annotations

import datetime as dt
import math
import random
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import Series
from ridgeline.operators import evaluation as ev
from ridgeline.operators import experiment as ex
from ridgeline.operators import indicators as ind
from ridgeline.operators import models, pools, prep, specs, sweep
from ridgeline.operators.bars import compute_bars
from ridgeline.operators.klines import presented
from ridgeline.sources import trades as tr


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


@pytest.fixture(scope="module")
def bars(spark):
    r, price, rows = random.Random(2), 100.0, []
    for i in range(330):
        new = price * (1 + r.gauss(0, 0.01))
        rows.append(("a", at(i), price, max(price, new) + 0.1, min(price, new) - 0.1, new, r.uniform(10, 90), r.random(), r.randint(5, 50)))
        price = new
    return spark.createDataFrame(rows, "series string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, maker_ratio double, no_of_trades long")


def simple():
    return ex.Manifest().add_indicator(ind.roc, period="p").with_target("up").add_fitted_transform(ex.flag_above).fit_param("_cut", ex.quantile_cutoff, col="roc_{p}", q="q").with_params(target_column="target_column", col="roc_{p}", cutoff="_cut").add_transform(ex.shifted, column="target_column", shift=-1).done()


def test_fitting_reads_the_training_split_only(spark, bars):
    params = {"p": 3, "q": 0.4}
    one = simple().prepare(bars, params)
    assert one.rows.columns[-1] == "up" and one.features == ["open", "high", "low", "close", "volume", "maker_ratio", "no_of_trades", "roc_3"]
    other = simple().prepare(bars.withColumn("close", F.when(F.col("datetime") >= F.lit(at(300)), F.col("close") * 7).otherwise(F.col("close"))), params)
    train = lambda p: [(r["datetime"], r["up"]) for r in p.rows.where("split = 'train'").orderBy("datetime").collect()]
    assert train(one) == train(other) and len(train(one)) == 240 - 3 - 1
    closes = {r["datetime"]: r["close"] for r in bars.collect()}
    roc = {at(i): closes[at(i)] / closes[at(i - 3)] - 1 for i in range(3, 240)}
    ranked = sorted(roc.values())
    cut = ranked[math.floor((len(ranked) - 1) * 0.6 + 0.5)]
    assert all(y == int(roc[t + dt.timedelta(hours=1)] > cut) for t, y in train(one))
    # nothing crosses from one split into the next: each loses its first three rows and its last
    assert {(r["datetime"].day - 1) * 24 + r["datetime"].hour for r in one.missing().collect()} == {0, 1, 2, 239, 240, 241, 242, 269, 270, 271, 272, 329}
    window = one.test_range().first()
    assert (window["first_test_datetime"], window["last_test_datetime"]) == (at(273), at(328))


def test_manifest_steps(spark, bars):
    m = simple().set_pre_split_data_selector(lambda df, n: df.where(F.col("datetime") < F.lit(at(n))), n="rows").set_split_config(1, 1, 2).set_scaler((("^close$", "standard"), (".*", "none")))
    found = m.prepare(bars, {"p": 1, "q": 0.5, "rows": 200})
    stats = found.rows.where("split = 'train'").agg(F.avg("close"), F.stddev_pop("close")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and found.bars.where("split = 'test'").count() == 100
    back = found.scaler.inverse(found.rows, found.fitted).join(bars.select("datetime", F.col("close").alias("c")), "datetime")
    assert back.agg(F.max(F.abs(F.col("close") - F.col("c")))).first()[0] < 1e-9
    by_bars = simple().set_bar_formation(lambda df, keys, size: compute_bars(df, "trade", size, keys=keys), size="n").set_required_bar_columns(["bar_count"])
    params = {"p": 1, "q": 0.5, "bar_type": "trade", "n": 100}
    bars = bars.withColumns({c: F.col("volume") for c in ("liquidity_sum", "maker_volume", "maker_liquidity", "mean")})
    assert by_bars.test_bars(bars, params).count() == by_bars.prepare(bars, params).bars.where("split = 'test'").count() < 40
    with pytest.raises(ValueError):
        by_bars.prepare(bars, params | {"bar_type": "base"})
    with pytest.raises(ValueError):
        ex.Manifest().with_target("none").done().prepare(bars)


def test_data_sources(spark, bars):
    m = ex.Manifest().set_data_source(lambda s, n: bars.limit(n), {"n": 5}).set_test_data_source(Source.rows, {"n": 3})
    assert m.fetch_data(spark).count() == 5 and m.fetch_test_data(spark).count() == 3
    with pytest.raises(ValueError):
        ex.Manifest().fetch_data(spark)
    spec = SimpleNamespace(params=lambda: {"p": [1], "q": [0.5]}, manifest=lambda: m.with_model(models.logreg_binary))
    assert ex.Experiment(spec, spark=spark).data.count() == 3 and ex.Experiment(spec, spark=spark, test=False).data.count() == 5


class Source:
    def rows(self, spark, n):
        return spark.range(n)


def test_experiment_runs_rounds_side_by_side(spark, bars, tmp_path):
    def model(data, strength, offset=0.5):
        assert data["extra"] == "yes" and data["x_train"].shape[1] == len(data["features"])
        p = 1 / (1 + np.exp(-strength * data["x_test"][:, data["features"].index("roc_2")]))
        return {"prediction": (p > offset).astype(float), "proba": p, "extras": {"n": len(p)}}

    spec = SimpleNamespace(params=lambda: {"p": [2], "q": [0.3, 0.5], "strength": [1.0, -1.0], "kind": ["x"]}, manifest=lambda: simple().with_model(model).add_to_data_dict(lambda data, params: data | {"extra": "yes"}))
    done = ex.Experiment(spec, bars).run(3, seed=4, context={"note": "hello"}, save_to=str(tmp_path / "outcomes"))
    assert len({tuple(sorted(p.items())) for p in done.rounds}) == 3 and all(p["note"] == "hello" for p in done.rounds)
    log = done.log().orderBy("round_id").collect()
    assert [r["round_id"] for r in log] == [0, 1, 2] and all(r["extras"] == '{"n": 57}' and r["seconds"] >= 0 and r["note"] == "hello" for r in log)
    same_q = [i for i, p in enumerate(done.rounds) if p["q"] == done.rounds[0]["q"]]
    if len(same_q) == 2:  # the opposite model
        assert log[same_q[0]]["auc"] == pytest.approx(1 - log[same_q[1]]["auc"])
    performance = done.performance()
    assert performance.count() == 3 * 57 and performance.where("hit = miss").count() == 0
    confusion = done.confusion("price_change", proba="proba", threshold=0.5)
    assert confusion.columns[:2] == ["round_id", "p"] and confusion.count() == 3 and {r["x_name"] for r in confusion.collect()} == {"price_change"}
    assert done.backtest().count() == 3
    assert done.test_rows(0).count() == 57 and "high" in done.test_rows(0).columns
    hot = ex.one_hot(done.log(), ["strength", "kind"])
    assert {"strength_1.0", "strength_-1.0", "kind_x"} <= set(hot.columns) and {r["kind_x"] for r in hot.collect()} == {1}
    with pytest.raises(ValueError):
        ex.Experiment(SimpleNamespace(params=lambda: {"p": [1], "q": [0.5]}, manifest=lambda: simple().with_model(model)), bars).run(1)


def test_a_spec_with_its_own_functions(spark, bars):
    spec = SimpleNamespace(params=lambda: {"p": [1, 2], "q": [0.5]}, prep=lambda df, p: simple().prepare(df, p), model=models.logreg_binary)
    assert ex.Experiment(spec, bars).run(2, random_search=False, prep_each_round=False).log().count() == 2
    with pytest.raises(ValueError):
        ex.Experiment(spec)


@pytest.mark.parametrize("name", sorted(specs.SPECS))
def test_ready_specs(spark, bars, name):
    spec = specs.SPECS[name]
    small = {"shift": [-1], "roc_period": [1, 4], "n_estimators": [15], "forward_periods": [2], "threshold_pct": [0.005]}
    params = {k: small.get(k, v) for k, v in spec.params().items()}
    done = ex.Experiment(spec, bars).run(2, seed=1, params=params)
    metrics = ev.continuous_metrics if name == "boosted" else ev.binary_metrics
    assert done.log(metrics).count() == 2


def test_chosen_models_are_trained_again(spark, bars):
    spec = SimpleNamespace(params=lambda: {"p": [1, 2, 3], "q": [0.5]}, manifest=lambda: simple().with_model(models.logreg_binary))
    done = ex.Experiment(spec, bars).run(random_search=False)
    chosen = spark.createDataFrame([(0, 0), (2, 1)], "round_id int, regime int")
    later = bars.withColumn("close", F.col("close") + 1)
    got = pools.rerun_pools(spec, later, done.rounds, chosen).orderBy("datetime").collect()
    direct = {i: {r["datetime"]: r["prediction"] for r in ex.Experiment(spec, later).run(rounds=[done.rounds[i]]).predictions.collect()} for i in (0, 2)}
    assert len(got) == len(direct[0]) and all(r["regime_0_prediction"] == direct[0][r["datetime"]] and r["regime_1_prediction"] == direct[2].get(r["datetime"]) for r in got)


def test_boosted_trees_learn_interactions_and_penalties():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = x[:, 0] * (x[:, 1] > 0) + 0.5 * x[:, 2] + 0.1 * r.normal(size=600)
    fit = lambda **k: models.fit_boosted(x[:400], y[:400], x[400:500], y[400:500], learning_rate=0.1, n_estimators=200, **k)(x[500:])
    error = lambda p: float(np.mean((p - y[500:]) ** 2))
    assert error(fit()) < 0.3 * y[500:].var() and error(fit()) == error(fit())
    assert error(fit(max_depth=1)) > error(fit(max_depth=3))
    assert np.ptp(fit(gamma=1e9)) == 0 and np.ptp(fit(min_child_weight=300)) == 0 and np.ptp(fit(reg_alpha=1e9)) == 0
    tree = models.grow_tree(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([-1.0, -1.0, 1.0, 1.0]), np.arange(4), [0], 1, 1, 0.0, 0.0, 0.0, 1.0)
    assert tree == [0, 1.5, -1.0, 1.0]


def test_isotonic_is_the_greatest_of_least_means():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 30, 200) / 30, r.integers(0, 2, 200)
    xs, ys = models.isotonic(x, y)
    mean = lambda a, b: y[(x >= xs[a]) & (x <= xs[b])].mean()
    n = len(xs)
    assert ys == pytest.approx([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_is_per_model_and_keeps_columns(spark, method):
    r = random.Random(5)
    rows = []
    for m, power in ((0, 1.0), (1, 3.0)):
        for i in range(800):
            p = round(r.random(), 2)
            rows.append((m, "val" if i % 2 else "test", p, int(r.random() < p**power), 9.0))
    df = spark.createDataFrame(rows + [(0, "test", None, 1, 9.0), (2, "test", 0.5, 1, 9.0)], "round_id int, split string, proba double, actual int, prediction double")
    got = sweep.calibrate(df, method=method)
    assert got.columns == [*df.columns, "calibrated"] and got.count() == len(rows) + 2
    gap = got.where("round_id = 1 AND split = 'test'").agg(F.avg(F.abs(F.col("calibrated") - F.col("proba") ** 3)), F.avg(F.abs(F.col("proba") - F.col("proba") ** 3))).first()
    assert gap[0] < 0.6 * gap[1]
    assert got.where("calibrated IS NULL").count() == 2
    with pytest.raises(ValueError):
        sweep.calibrate(df, method="other")


def test_outliers_and_thresholds_as_in_the_definition(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (1, 2, 3, 4, 5, 6, 7, 1000)] + [(None, 1.0)], "a double, b double")
    assert sorted(r["a"] for r in pools.iqr_filter(df, ["a", "b"]).collect()) == [1, 2, 3, 4, 5, 6, 7]
    same = spark.createDataFrame([(5.0,)] * 6 + [(1.0,), (9.0,)], "a double")
    assert pools.iqr_filter(same, ["a"]).count() == 8
    rows = [(0, 1, 0.5), (0, 0, 0.31), (0, 1, 0.31), (1, 1, 0.1), (1, 0, 0.1)]
    scores = spark.createDataFrame(rows, "round_id int, actual int, proba double")
    got = {m: {r["round_id"]: (round(r["threshold"], 6), round(r[m], 6)) for r in ev.optimize_threshold(scores, metric=m).collect()} for m in ("balanced", "f1", "precision", "accuracy")}
    assert all(v[1] == (0.35, -1.0) for v in got.values())
    for m, v in got.items():
        own = models.best_threshold([1, 0, 1], np.array([0.5, 0.31, 0.31]), m)
        assert v[0] == (round(own[0], 6), round(own[1], 6))


def test_quantiles_by_rank(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.random() if r.random() > 0.1 else None, r.randint(0, 9)) for _ in range(300)]
    got = {x["k"]: x for x in prep.quantiles(spark.createDataFrame(rows, "k string, x double, n int"), ["k"], {"low": ("x", 0.25), "high": ("n", 0.9)}).collect()}
    for k in "ab":
        for name, i, q in (("low", 1, 0.25), ("high", 2, 0.9)):
            values = sorted(v[i] for v in rows if v[0] == k and v[i] is not None)
            assert got[k][name] == values[math.floor((len(values) - 1) * q + 0.5)]


def test_klines_are_rounded_for_presentation(spark):
    df = spark.createDataFrame([(1.23456789, 2.123456789, 3.14, "x")], "mean double, std double, liquidity_sum double, series string")
    assert tuple(presented(df).first()) == (1.23457, 2.123457, 3.1, "x")


def test_readers_and_sinks(spark, tmp_path):
    log = spark.createDataFrame([(0, 0.5, "x"), (1, None, "y, z")], "round_id int, auc double, kind string")
    for _ in range(2):
        tr.write_log(log, str(tmp_path / "log"))
        tr.write_log(log, str(tmp_path / "csv"), "csv")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    read = tr.read_log(spark, str(tmp_path / "csv"), log.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), marker="round_id")
    assert sorted(map(str, read.collect())) == sorted(map(str, log.union(log).collect()))
    with zipfile.ZipFile(tmp_path / "raw.zip", "w") as z:
        z.writestr("raw.csv", "1,2.5,3.0,7.5,1700000000000,true\n2,2.5,3.0,7.5,1700000000000001,false\n")
    (tmp_path / "raw.csv").write_text("1,2.5,3.0,7.5,1700000000000,true\n2,2.5,3.0,7.5,1700000000000001,false\n")
    raw = [f(spark, str(tmp_path / name), tr.RAW_SCHEMAS["futures_trades"]) for f, name in ((tr.read_zipped_csv, "raw.zip"), (tr.read_csv, "raw.csv"))]
    assert raw[0].collect() == raw[1].collect() and [r["timestamp"] for r in raw[1].orderBy("trade_id").collect()] == [1700000000000] * 2
    tr.to_sqlite(log, str(tmp_path / "log.sqlite"), "runs")
    tr.to_sqlite(log, str(tmp_path / "log.sqlite"), "runs")
    import sqlite3

    with sqlite3.connect(tmp_path / "log.sqlite") as con:
        assert con.execute("SELECT round_id, auc, kind FROM runs ORDER BY 1, 3").fetchall() == [(0, 0.5, "x")] * 2 + [(1, None, "y, z")] * 2
    assert spark.createDataFrame([("a", at(0), 1.0)], "series string, datetime timestamp_ntz, close double").transform(lambda d: ex.shifted(d, Series(), "close", 1)).first()["close"] is None
