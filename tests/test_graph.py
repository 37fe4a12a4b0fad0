"""The feature graph of many rounds against each round prepared for itself, and what it shares."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.columns import fdiv
from ridgeline.operators import experiment as ex
from ridgeline.operators import features as ft
from ridgeline.operators import indicators as ind
from ridgeline.operators import prep, specs, sweep
from ridgeline.operators.bars import compute_bars
from ridgeline.operators.graph import FeatureGraph, changes_rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for name in "ab":
        r, price = random.Random(name), 100.0
        for i in range(220):
            new = price * (1 + r.gauss(0, 0.01))
            rows.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), price, max(price, new) + 0.1, min(price, new) - 0.1, new, r.uniform(10, 90), r.random(), r.randint(5, 50)))
            price = new
    df = spark.createDataFrame(rows, "series string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, maker_ratio double, no_of_trades long")
    return df.withColumns({c: F.col("volume") for c in ("liquidity_sum", "maker_volume", "maker_liquidity", "mean")})


def same_rows(manifest, bars, rounds, **options):
    """Compare the graph's packed rows with each round's own; returns the graph."""
    graph = FeatureGraph(manifest, bars, rounds, **options)
    got = {}
    for r in graph.packed.collect():
        got.setdefault(r["round_id"], []).append((r["series"], r["datetime"], r["split"], tuple(r["x"]), r["y"]))
    for i, p in enumerate(rounds):
        own = manifest.prepare(bars, p)
        assert own.features == graph.features[i]
        want = [(r["series"], r["datetime"], r["split"], tuple(r["x"]), r["y"]) for r in own.packed(i).collect()]
        assert sorted(map(repr, got.get(i, []))) == sorted(map(repr, want)), p
    return graph


def unscaled(spec):
    m = spec.manifest()
    m.scaler_rules = None
    return m


def test_equal_to_rounds_prepared_alone(bars):
    rounds = [{"roc_period": p, "q": q, "shift": s} for p in (1, 4) for q in (0.35, 0.5) for s in (-1, -2)]
    graph = same_rows(unscaled(specs.SPECS["logreg"]), bars, rounds)
    # roc twice, five other indicators, four cut-offs, four flags, eight shifts
    assert graph.nodes == 2 + 5 + 4 + 4 + 8 and len(graph.frames) == 1


def test_columns_of_one_name_and_different_arguments(bars):
    rounds = [{"rsi_period": p, "bb_window": w, "bb_std": s, "forward_periods": 2, "threshold_pct": 0.005} for p in (7, 14) for w, s in ((10, 1.5), (20, 1.5), (20, 2.5))]
    graph = same_rows(specs.SPECS["calibrated"].manifest(), bars, rounds)
    # seven fixed, two of the index, three bands, three positions in them, one target: the target doesn't ask for the bands
    assert graph.nodes == 7 + 2 + 3 + 3 + 1


def test_steps_that_overwrite_drop_reuse_and_change_rows(bars):
    def halved(df, s, by):
        return df.withColumn("close", F.col("close") / by)

    def without(df, s, name):
        return df.drop(name)

    def narrow(df, s):
        return df.select(*s.keys, *s.order, "close", "volume", "label")

    m = ex.Manifest().add_feature(halved, by="by").add_feature(ft.volume_ratio, period="vp").add_feature(ft.volume_trend, short_period=5, long_period="vp").add_feature(without, name="lost")
    m = m.add_feature(ft.sma_ratios, periods=[3, 5]).with_target("label").add_transform(lambda df, s: df.withColumn("label", s.lag("close", -1))).done()
    rounds = [{"by": b, "vp": v, "lost": n} for b in (1, 2) for v in (5, 9) for n in ("open", "high")]
    graph = same_rows(m, bars, rounds)
    assert len(graph.frames) == 1
    same_rows(m.with_target("label").add_transform(narrow).done(), bars, rounds[:3])
    drops = ex.Manifest().add_indicator(ind.roc, period="p").with_target("breakout_ema").add_transform(ft.ema_breakout, target_col="close", ema_span=5, breakout_delta="d", breakout_horizon=3).done()
    graph = same_rows(drops, bars, [{"p": p, "d": d} for p in (1, 2) for d in (0.0, 0.01)])
    assert len(graph.frames) == 1 + 4


def test_selectors_bars_and_fits_without_many(bars):
    def middle(train, keys, col):
        return train.groupBy(*keys).agg(F.avg(col).alias("value"))

    m = ex.Manifest().set_pre_split_data_selector(lambda df, n: df.where(F.hour("datetime") < n), n="hours")
    m = m.set_bar_formation(lambda df, keys, size: compute_bars(df, "trade", size, keys=keys), size="size").add_indicator(ind.roc, period="p")
    m = m.with_target("up").add_fitted_transform(ex.flag_above).fit_param("_cut", middle, col="roc_{p}").with_params(target_column="target_column", col="roc_{p}", cutoff="_cut").add_transform(ex.shifted, column="target_column", shift=-1).done()
    rounds = [{"hours": h, "p": p, "bar_type": t, "size": 90} for h in (24, 20) for p in (1, 3) for t in ("base", "trade")]
    graph = same_rows(m, bars, rounds)
    assert len(graph.frames) == 4 and sorted(set(graph.base_of)) == [0, 1, 2, 3]


def test_scaling_in_the_task_equals_the_scaler(bars):
    rules = (("^close$", "standard"), ("^volume$", "log_standard"), ("^roc_.*", "divide_100"), ("^next$", "standard"), (".*", "none"))
    m = ex.Manifest().add_indicator(ind.roc, period="p").with_target("next").add_transform(lambda df, s: df.withColumn("next", s.lag("close", -1))).done().set_scaler(rules)
    seen = lambda data: {"prediction": data["x_test"].sum(axis=1), "proba": data["y_test"]}
    odd = bars.withColumn("volume", F.when(F.hour("datetime") == 3, F.lit(-2.0)).otherwise(F.col("volume")))
    one = m.prepare(odd, {"p": 2})
    packed = {r["datetime"]: (sum(r["x"]), r["y"]) for r in one.packed(0).where("split = 'test' AND series = 'a'").collect()}
    from types import SimpleNamespace

    done = ex.Experiment(SimpleNamespace(params=lambda: {"p": [2]}, manifest=lambda: m.with_model(seen)), odd).run()
    got = {r["datetime"]: (r["prediction"], r["proba"]) for r in done.predictions.where("series = 'a'").collect()}
    assert got.keys() == packed.keys() and len(got) > 20
    assert all(got[t] == pytest.approx(packed[t], rel=1e-9) for t in got)


def test_a_hundred_rounds_plan_in_seconds_and_scan_once(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "bars"))
    source = spark.read.parquet(str(tmp_path / "bars"))
    began = time.time()
    done = ex.Experiment(specs.SPECS["logreg"], source).run(100, seed=5, stage_in=str(tmp_path), params={**specs.LOGREG, "roc_period": [1, 4, 8, 12, 24]})
    files = done.graph.packed.inputFiles()
    assert files and all("/features-" in f for f in files)  # the source is read once, to write the features
    assert time.time() - began < 90
    log = done.log()
    assert log.count() == 200 and log.select("round_id").distinct().count() == 100
    few = ex.Experiment(specs.SPECS["logreg"], source).run(rounds=done.rounds[:3])
    want = {(r["round_id"], r["series"]): (r["auc"], r["recall"]) for r in few.log().collect()}
    assert want == {(r["round_id"], r["series"]): (r["auc"], r["recall"]) for r in log.where("round_id < 3").collect()}


def test_what_changes_rows(spark, bars):
    assert not changes_rows(ind.atr(bars)) and not changes_rows(ft.vwap(bars).withColumn("x", fdiv("close", "open")))
    assert changes_rows(bars.where("close > 0")) and changes_rows(bars.join(bars.select("series").distinct(), "series")) and changes_rows(bars.limit(3))


def test_no_target_and_wrong_columns(bars):
    with pytest.raises(ValueError):
        FeatureGraph(ex.Manifest().with_target("none").done(), bars, [{}])
    with pytest.raises(Exception, match="nowhere"):
        FeatureGraph(ex.Manifest().add_indicator(ind.sma, column="nowhere", period=3).with_target("close").done(), bars, [{}])


def test_scaled_rows_without_a_logarithm():
    import numpy as np

    v = np.array([[1.0, -2.0], [3.0, 0.0], [5.0, 1.0], [7.0, 2.0]])
    out = sweep.scaled(v, np.array([True, True, True, False]), ["standard", "log_standard"])
    assert out[:, 0].tolist() == pytest.approx([-1.2247448, 0, 1.2247448, 2.4494897]) and np.isnan(out[0, 1])
    assert out[1:3, 1].tolist() == pytest.approx([-1, 1])


def test_prepared_rounds_are_kept(bars):
    m = specs.SPECS["logreg"]
    done = ex.Experiment(m, bars).run(rounds=[{"roc_period": 1, "q": 0.4, "shift": -1, "class_weight": 0.5, "C": 1.0, "max_iter": 50, "tol": 1e-8}])
    assert done.prepared(0) is done.prepared(0) and done.test_rows(0).count() == done.predictions.count()
    assert done.performance().count() == done.predictions.count() and prep.missing_datetimes(done.prepared(0).bars, done.prepared(0).rows).count() > 0
