"""As-of and interval joins against all pairs."""

from __future__ import annotations

import random

import pytest

from ridgeline.operators import time_joins as tj

LEFT, RIGHT = "series string, datetime long, price double, note string", "series string, datetime long, price double, id int"


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(2)
    left = [(r.choice("abc"), r.randint(0, 200), r.random(), "x") for _ in range(300)] + [(None, 5, 1.0, "y"), ("a", None, 2.0, "y"), ("only", 7, 3.0, "y")]
    right = [(r.choice("abc"), r.randint(20, 180), r.random(), i) for i in range(60)] + [(None, 5, 1.0, 99), ("b", None, 1.0, 98), ("a", 100, 0.1, 1000), ("a", 100, 0.9, 1001)]
    return left + left[:5], right, spark.createDataFrame(left + left[:5], LEFT), spark.createDataFrame(right, RIGHT)


def plain(left, right, direction, tolerance, exact):
    out = []
    for k, t, *rest in left:
        best = None
        for k2, t2, p2, i2 in right:
            if k is None or t is None or k2 != k or t2 is None or (t2 == t and not exact) or (tolerance is not None and abs(t2 - t) > tolerance):
                continue
            if direction == "backward" and t2 > t or direction == "forward" and t2 < t:
                continue
            rank = (-abs(t2 - t), t2 <= t, (t2, p2, i2))
            if best is None or rank > best[0]:
                best = (rank, (t2, p2, i2))
        out.append((k, t, *rest, *(best[1] if best else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_rows", [None, 40])
@pytest.mark.parametrize(("direction", "tolerance", "exact"), [("backward", None, True), ("backward", 3, False), ("forward", None, False), ("forward", 5, True), ("nearest", None, True), ("nearest", 2, False)])
def test_asof_equals_all_pairs(sides, direction, tolerance, exact, segment_rows):
    left, right, a, b = sides
    got = tj.asof_join(a, b, direction=direction, tolerance=tolerance, exact=exact, segment_rows=segment_rows)
    assert got.columns == ["series", "datetime", "price", "note", "datetime_right", "price_right", "id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(left, right, direction, tolerance, exact)


def test_asof_of_nothing_and_wrong_directions(sides):
    left, _, a, b = sides
    assert tj.asof_join(a, b.limit(0)).where("id IS NOT NULL").count() == 0 and tj.asof_join(a, b.limit(0)).count() == len(left)
    assert tj.asof_join(a.limit(0), b).count() == 0
    assert tj.asof_join(a, b, columns=["id"]).columns == [*a.columns, "id"]
    with pytest.raises(ValueError):
        tj.asof_join(a, b, direction="up")


@pytest.mark.parametrize("closed", ["left", "both"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_equal_all_pairs(spark, sides, closed, how):
    left, _, a, _ = sides
    r = random.Random(7)
    spans = [(r.choice("abc"), s, s + r.choice([0, 1, 3, 40, 190]), i) for i, s in enumerate(r.randint(-5, 200) for _ in range(50))] + [(None, 0, 9, 97), ("a", 9, 3, 98), ("a", None, 3, 99)]
    got = tj.interval_join(a, spark.createDataFrame(spans, "series string, start long, end long, note int"), how=how, closed=closed)
    assert got.columns == [*a.columns, "start", "end", "note_right"]
    want = []
    for row in left:
        k, t = row[:2]
        met = [(s, e, i) for k2, s, e, i in spans if None not in (k, t, s) and k2 == k and s <= t and (t < e or closed == "both" and t == e)]
        want += [(*row, *m) for m in met] or ([(*row, None, None, None)] if how == "left" else [])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    if how == "left":
        assert tj.interval_join(a, spark.createDataFrame([], "series string, start long, end long"), how="left").count() == a.count()
