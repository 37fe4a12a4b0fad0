from __future__ import annotations

import time

import numpy as np
import pytest

from ridgeline.operators import evaluation
from ridgeline.plans import catalogue


def test_kendall_is_tau_b(spark):
    rows = [("r", x, y) for x, y in ((1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0), (None, 1.0))] + [("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "round_id string, a double, b double")
    got = {r["round_id"]: r["correlation"] for r in evaluation.rank_correlation(df, "a", "b", ["round_id"], "kendall").collect()}
    assert got["r"] == pytest.approx((7 - 1) / 9) and got["flat"] is None  # ten pairs, one tie in each
    with pytest.raises(ValueError):
        evaluation.rank_correlation(df, "a", "b", ["round_id"], "other")


def test_registered_correlation_has_the_references_cohorts(spark, monkeypatch):
    log = spark.createDataFrame([(0.5 + i / 100, i % 4, i % 2 / 10, 10.0 ** (i % 3)) for i in range(8)], "auc double, roc_period long, q double, c double")
    monkeypatch.setattr(catalogue, "sweep_logreg", lambda spark, sf_dir: log)
    asked = {}
    whole = evaluation.parameter_correlation
    monkeypatch.setattr(evaluation, "parameter_correlation", lambda *a, **b: asked.update(b) or whole(*a, **b))
    heads = {r["head"] for r in catalogue.parameter_correlation(spark, "").collect()}
    assert heads == {0.99, 0.75, 0.5, 0.25, 0.01} and asked["n_boot"] == 300


def test_kendall_pairs_equal_all_pairs():
    r = np.random.default_rng(0)
    for n, spread in ((0, 3), (1, 3), (2, 1), (60, 4), (200, 1000), (300, 2)):
        x, y = r.integers(0, spread, n).astype(float), r.integers(0, spread, n) / 7
        dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
        assert evaluation.kendall_pairs(x, y) == (int((dx * dy).sum()) // 2, int((dx != 0).sum()) // 2, int((dy != 0).sum()) // 2)


def test_kendall_of_a_million_rows_takes_seconds():
    r = np.random.default_rng(1)
    x = r.normal(size=1_000_000)
    began = time.time()
    same, in_x, in_y = evaluation.kendall_pairs(x, x + r.normal(size=len(x)))
    assert time.time() - began < 30 and 0.45 < same / in_x < 0.55 and in_x == in_y


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_bootstrap_is_drawn_on_executors(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluation, "BROADCAST_BYTES", limit)
    r = np.random.default_rng(2)
    p = r.normal(size=200)
    log = spark.createDataFrame([(float(v + r.normal()), float(v), float(r.normal()), "text") for v in p], "auc double, p double, noise double, kind string")
    got = {(x["head"], x["param"]): x for x in evaluation.parameter_correlation(log, "auc", ["p", "noise", "kind"], heads=(1.0, 0.5), n_boot=60, seed=3).collect()}
    again = {(x["head"], x["param"]): x for x in evaluation.parameter_correlation(log.repartition(5), "auc", ["p", "noise", "kind"], heads=(1.0, 0.5), n_boot=60, seed=3).collect()}
    assert got == again and got[1.0, "p"]["correlation"] > 0.55 and got[1.0, "p"]["sign_stability"] == 1
    assert all(x["ci_low"] <= x["boot_median"] <= x["ci_high"] for x in got.values() if x["boot_median"] is not None)
    assert got[1.0, "p"]["ci_low"] < got[1.0, "p"]["correlation"] < got[1.0, "p"]["ci_high"] and (1.0, "kind") not in got
