"""Fits from grouped sums against fits inside one task."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import experiment as ex
from ridgeline.operators import large_models as lm
from ridgeline.operators import models, specs, sweep

SETTINGS = {0: {"C": 1.0, "class_weight": 0.5, "max_iter": 60, "tol": 1e-10}, 1: {"C": 0.05, "class_weight": 1.0, "max_iter": 60, "tol": 1e-10}, 2: {"C": 10.0, "max_iter": 2, "tol": 1e-12}}


@pytest.fixture(scope="module")
def packed(spark):
    r, rows = np.random.default_rng(3), []
    for i, d in ((0, 2), (1, 5), (2, 2)):
        for name, n in (("a", 300), ("b", 60), (None, 40)):
            x = r.normal(size=(n, d))
            y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=n) > 0).astype(float)
            rows += [(i, name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), "train" if k < 0.7 * n else "test", x[k].tolist(), float(y[k])) for k in range(n)]
    rows += [(0, "a", dt.datetime(2025, 1, 1), "train", [float("nan"), 0.0], 1.0), (0, "lonely", dt.datetime(2025, 1, 1), "train", [1.0, 0.0], 1.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "round_id int, series string, datetime timestamp_ntz, split string, x array<double>, y double").repartition(7)


def in_task(rows, settings):
    out = {}
    for i, name in {(r["round_id"], r["series"]) for r in rows}:
        own = [r for r in rows if (r["round_id"], r["series"]) == (i, name) and np.isfinite(r["x"]).all()]
        train, test = ([r for r in own if r["split"] == s] for s in ("train", "test"))
        if len(train) > 1:
            s = settings[i]
            f = models.fit_logistic(np.array([r["x"] for r in train]), np.array([r["y"] for r in train]), s.get("C", 1.0), s.get("class_weight", 1.0), s["max_iter"], s["tol"])
            out |= {(i, name, r["datetime"]): float(f(np.array([r["x"]]))[0]) for r in test}
    return out


@pytest.mark.parametrize("limits", [(8 << 20, 2_000), (0, 1)])
def test_equal_to_the_fit_in_one_task(packed, monkeypatch, limits):
    monkeypatch.setattr(lm, "BROADCAST_BYTES", limits[0])
    monkeypatch.setattr(lm, "MOST_OPEN", limits[1])
    named = packed.withColumn("series", F.coalesce("series", F.lit("none")))  # rows are joined by key
    fitted = lm.fit_logistic(named, SETTINGS)
    got = {(r["round_id"], r["series"], r["datetime"]): r["proba"] for r in lm.predict(named, fitted).collect()}
    want = in_task(named.collect(), SETTINGS)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    steps = {(r["round_id"], r["series"]): r["steps"] for r in fitted.collect()}
    assert steps[2, "a"] == 2 and 2 < steps[0, "a"] < 20 and (0, "lonely") not in steps


def test_nothing_to_fit(packed):
    assert lm.fit_logistic(packed.limit(0), SETTINGS).count() == 0
    assert lm.fit_logistic(packed.where("series = 'lonely'"), SETTINGS).count() == 0


def test_scaling_by_grouped_sums(packed):
    rules = {0: ["standard", "log_standard", "none"], 1: ["divide_100", "none", "standard", "standard", "none", "none"], 2: ["none", "none", "standard"]}
    own = packed.where("series = 'a' AND datetime < '2025-01-01'")
    got = {(r["round_id"], r["datetime"]): [*r["x"], r["y"]] for r in lm.scaled(own, rules).collect()}
    for i, r in rules.items():
        rows = own.where(f"round_id = {i}").orderBy("datetime").collect()
        want = sweep.scaled(np.array([[*x["x"], x["y"]] for x in rows]), np.array([x["split"] == "train" for x in rows]), r)
        for x, w in zip(rows, want, strict=True):
            have = got.get((i, x["datetime"]))
            assert have is None if np.isnan(w).any() else have == pytest.approx(w.tolist(), rel=1e-9, abs=1e-12)


def test_experiments_fitted_either_way(spark):
    rows, price, r = [], 100.0, random.Random(6)
    for i in range(400):
        new = price * (1 + r.gauss(0, 0.01))
        rows.append(("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), price, max(price, new) + 0.1, min(price, new) - 0.1, new, r.uniform(10, 90), r.random(), r.randint(5, 50)))
        price = new
    bars = spark.createDataFrame(rows, "series string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, maker_ratio double, no_of_trades long")
    rounds = [{"roc_period": p, "q": 0.4, "shift": -1, "class_weight": 0.6, "C": 0.5, "max_iter": 60, "tol": 1e-9} for p in (1, 4)]
    experiment = ex.Experiment(specs.SPECS["logreg"], bars)
    large = {(r["round_id"], r["datetime"]): r["proba"] for r in experiment.fit_large(rounds=rounds).collect()}
    small = {(r["round_id"], r["datetime"]): r["proba"] for r in ex.Experiment(specs.SPECS["logreg"], bars).run(rounds=rounds).predictions.collect()}
    assert large.keys() == small.keys() and len(small) > 100 and max(abs(large[k] - small[k]) for k in small) < 1e-6
    with pytest.raises(ValueError):
        ex.Experiment(specs.SPECS["random"], bars).fit_large(1)
