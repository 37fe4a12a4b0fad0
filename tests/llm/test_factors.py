"""The Relative Lempel-Ziv factors of small texts."""

from __future__ import annotations

import random

from ridgeline.llm import substring_dedup


def unlike(name, n):
    return [f"{name}{i}" for i in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def factors(spark, texts):
    return {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup.find_spans(frame(spark, texts)).collect()}


def test_the_parse_walks_from_left_to_right():
    # windows 0-27 and 28-40 follow one another here as they do in reference 7; then another reference begins
    assert substring_dedup.parse([(0, 28, 7, 100, 9, 0), (28, 13, 7, 128, 7, 128), (60, 5, 9, 10, 9, 10)]) == [(0, 75, 7, 100), (60, 99, 9, 10)]
    # the second reference goes on where the first doesn't
    assert substring_dedup.parse([(0, 20, 7, 100, 7, 100), (20, 10, 3, 5, 7, 120)]) == [(0, 64, 7, 100)]
    assert substring_dedup.parse([]) == []


def test_a_copied_document_is_one_factor(spark):
    text = unlike("a", 200)
    found = factors(spark, [text, text, unlike("b", 100), None, []])
    assert found == {0: [(0, 200, 1, 0)], 1: [(0, 200, 0, 0)], 2: [], 3: [], 4: []}


def test_factors_are_copies_and_end_with_them(spark):
    r = random.Random(8)
    passage, other = unlike("p", 120), unlike("q", 90)
    texts = [unlike("x", 50) + passage + unlike("y", 30), unlike("z", 20) + passage + other, other + unlike("v", 40), passage[:80] + unlike("u", 9) + other]
    texts += [[r.choice("ab") for _ in range(300)] for _ in range(3)]
    found = factors(spark, texts)
    for i, own in found.items():
        for begin, end, ref, at in own:
            assert end - begin >= 35 and texts[i][begin:end] == texts[ref][at : at + end - begin] and (i, begin) != (ref, at)
    # windows at a copy's ends belong to its factor
    assert found[1][-1][:2] == (140, 230) and [f[:2] for f in found[2]] == [(0, 90)]
    assert any(f[2] == 0 and f[1] - f[0] >= 60 for f in found[1]) and any(f[2] == 1 or f[2] == 3 for f in found[2])
    rows = substring_dedup.find_spans(frame(spark, texts[:4])).collect()
    assert [(r["n_removed"], [tuple(s) for s in r["spans"]]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(120, [(50, 170)]), (210, [(20, 230)]), (90, [(0, 90)]), (170, [(0, 80), (89, 179)])]


def test_spans_are_what_the_factors_cover(spark):
    r = random.Random(5)
    passages = [unlike(f"p{i}_", r.randint(30, 150)) for i in range(8)]
    texts = [sum(([f"u{i}_{j}"] * r.randint(0, 3) + unlike(f"v{i}_{j}_", r.randint(0, 40)) + r.choice(passages)[r.randint(0, 5) :] for j in range(4)), []) for i in range(40)]
    places: dict[tuple, int] = {}
    for t in texts:
        for at in range(len(t) - 34):
            places[tuple(t[at : at + 35])] = places.get(tuple(t[at : at + 35]), 0) + 1
    for row in substring_dedup.find_spans(frame(spark, texts)).collect():
        own = texts[row["doc_id"]]
        gone = {i for at in range(len(own) - 34) if places[tuple(own[at : at + 35])] > 1 for i in range(at, at + 35)}
        assert gone == {i for f in row["factors"] for i in range(f["begin"], f["end"])} == {i for s in row["spans"] for i in range(s["begin"], s["end"])}
        assert all(own[f["begin"] : f["end"]] == texts[f["ref"]][f["ref_begin"] : f["ref_begin"] + f["end"] - f["begin"]] for f in row["factors"])


def test_a_passage_that_stands_twice_is_one_factor_to_its_last_word(spark):
    for seed in range(3):
        passage = unlike(f"p{seed}_", 36 + 29 * seed)
        found = factors(spark, [unlike("x", 17) + passage + unlike("y", 40), unlike("z", 51) + passage + unlike("w", 5)])
        assert found == {0: [(17, 17 + len(passage), 1, 51)], 1: [(51, 51 + len(passage), 0, 17)]}


def test_columns_with_the_operators_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, " ".join(unlike("a", 40)), "n", 5, 6, 7), (2, " ".join(unlike("a", 40)), "n", 5, 6, 7), (3, None, None, None, None, None)], "doc_id long, text string, factors string, n_words int, block int, __text int")
    found = substring_dedup.find_spans(df)
    assert found.columns == ["doc_id", "text", "block", "__text", "n_words", "n_removed", "spans", "factors", "kept_text"]
    assert sorted((r["doc_id"], r["block"], r["__text"], r["n_removed"]) for r in found.where("doc_id < 3").collect()) == [(1, 6, 7, 40), (2, 6, 7, 40)]
    left = substring_dedup.remove_duplicates(df)
    assert left.columns == df.columns and {(r["doc_id"], r["text"], r["factors"]) for r in left.collect()} == {(1, "", "n"), (2, "", "n"), (3, None, None)}
    assert substring_dedup.find_spans(df.limit(0)).count() == 0 and substring_dedup.remove_duplicates(df.limit(0)).count() == 0
