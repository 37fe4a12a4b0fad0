"""Decontamination against every diagonal of every pair, and its edge cases."""

from __future__ import annotations

import random

import numpy as np

from ridgeline.llm import decontamination


def brute(docs, items, min_words=13):
    """Every maximal run of every diagonal, without seeds."""
    out = set()
    for i, doc in docs:
        for k, item in items:
            a, b = (doc or "").lower().split(), (item or "").lower().split()
            least = min_words if len(b) >= min_words else -(-len(b) * 8 // 10)
            for d in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -d), min(len(b), len(a) - d)
                equal = np.array([a[x + d] == b[x] for x in range(lo, hi)])
                for begin, end in decontamination.runs(np.where(equal, 1, -decontamination.MISMATCH), max(least, 1)):
                    if (n := int(equal[begin:end].sum())) >= max(least, 1):
                        out.add((i, k, lo + d + begin, lo + d + end, lo + begin, lo + end, n))
    return out


def leaks(spark, docs, items, **options):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in decontamination.find_leaks(df, bench, **options).collect()}


def test_overlaps_are_those_of_every_diagonal(spark):
    r = random.Random(11)
    prose = lambda n: [f"w{r.randint(0, 900)}" for _ in range(n)]
    items = [prose(r.randint(15, 70)) for _ in range(12)]
    verbatim, changed = [], []
    for i in range(60):
        item = items[i % 12]
        a = r.randint(0, len(item) - 14)
        part = item[a : a + r.randint(13, 40)]
        verbatim.append((i, " ".join(prose(r.randint(0, 40)) + part + prose(r.randint(0, 40)))))
        spoiled = [w if (j + i) % 9 else "other" for j, w in enumerate(item)]
        changed.append((100 + i, " ".join(prose(r.randint(0, 40)) + spoiled + prose(5))))
    named = [(k, " ".join(t)) for k, t in enumerate(items)]
    assert leaks(spark, verbatim, named) == brute(verbatim, named)
    expected, found = brute(changed, named), leaks(spark, changed, named)
    assert found <= expected and len(expected) > 20 and len(found) >= 0.9 * len(expected)


def test_two_passages_of_an_item_are_two_overlaps(spark):
    item = [f"i{k}" for k in range(80)]
    doc = ["x"] * 5 + item[:20] + ["y"] * 20 + item[40:75]
    assert leaks(spark, [(1, " ".join(doc))], [(7, " ".join(item))]) == {(1, 7, 5, 25, 0, 20, 20), (1, 7, 45, 80, 40, 75, 35)}


def test_seeds_shared_by_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_MOST_HITS", 7)
    shared = [f"s{k}" for k in range(16)]
    items = [(k, " ".join(shared + [f"own{k}_{j}" for j in range(9)])) for k in range(30)]
    w = next(decontamination.textkit.words(decontamination.textkit.utf8(decontamination.pa.array([" ".join(["a"] + shared + ["b"] + shared)]))))
    assert sorted(f[1:4] for f in decontamination.Index([k for k, _ in items], [t for _, t in items]).leaks(w)) == sorted((k, b, b + 16) for k in range(30) for b in (1, 18))


def test_ids_of_any_type_clashing_names_ties_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"v{k}" for k in range(60_000)) + " " + text
    docs = spark.createDataFrame([("a", text, 1), ("a", text, 1), ("b", None, 2), ("c", "", 3), ("d", long, 4)], "item_id string, text string, n_matched int")
    bench = spark.createDataFrame([("q/1", text), ("q/1", text), (None, text), ("q/2", None)], "item_id string, text string")
    found = decontamination.find_leaks(docs, bench, id_col="item_id")
    assert found.columns == ["document_item_id", "item_id", *decontamination.COLUMNS]
    rows = sorted(str(tuple(r)[:3]) for r in found.collect())
    assert rows == sorted(str(x) for x in [(d, i, b) for d, b in (("a", 0), ("a", 0), ("d", 60_000)) for i in ("q/1", "q/1", None)])
    assert sorted(map(str, decontamination.find_leaks(docs, bench, id_col="item_id", block_items=1).collect())) == sorted(map(str, found.collect()))
    assert decontamination.find_leaks(docs.limit(0), bench, id_col="item_id").count() == 0 and decontamination.find_leaks(docs, bench.limit(0), id_col="item_id").count() == 0
    left = decontamination.decontaminate(docs, bench, id_col="item_id")
    assert left.columns == docs.columns and sorted(r["item_id"] for r in left.collect()) == ["b", "c"]
    assert decontamination.decontaminate(docs.limit(0), bench, id_col="item_id").count() == 0
