"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, html_extract, language_id, substring_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def unlike(name, n):
    """A text of n words that stand nowhere else."""
    return [f"{name}{i}" for i in range(n)]


def changed(text, *places):
    return ["changed" if i in places else w for i, w in enumerate(text)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t if t is None else " ".join(t), "aa", "s", 1) for i, t in rows], DOCS)


def test_near_copies_just_above_the_pipelines_threshold_are_one(spark):
    a, b, c = unlike("a", 50), unlike("b", 100), unlike("c", 49)
    rows = [(1, a), (2, changed(a, 25)), (3, b), (4, changed(b, 30, 70)), (5, c), (6, changed(c, 24))]  # 41/51, 86/106, 40/50 of five words
    rows += [(7, unlike("d", 48)), (8, changed(unlike("d", 48), 24))]  # 39/49: below
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7, 8]


def test_one_row_stays_of_copies_with_shared_or_null_ids(spark):
    a, b, c, d, e = (unlike(x, 60) for x in "abcde")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, c), (7, c), (5, d), (5, e), (6, e), (None, changed(e, 30)), (None, None), (None, None), (9, []), (9, [])]
    one = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    expected = [(1, a), (None, b), (7, c), (5, d), (5, e), (None, None), (None, None), (9, []), (9, [])]
    text = lambda t: t if t is None else " ".join(t)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in one.collect()))) == sorted(str((i, text(t))) for i, t in expected)
    left = corpus_pipeline.remove_repeated_passages(spark, one, "")
    assert sorted(r["text"] for r in left.collect()) == sorted(text(t) for t in (a, b, c, d, e))


def test_texts_with_one_32_bit_hash_under_one_id_are_told_apart(spark):
    a, b = (" ".join(f"w{n}_{i}" for i in range(40)) for n in (60599, 114291))
    for one in (None, 5):
        df = spark.createDataFrame([(one, a), (one, b), (1, a)], "doc_id long, text string")
        assert df.select(F.hash("text")).where(f"doc_id IS NOT DISTINCT FROM {'NULL' if one is None else one}").distinct().count() == 1
        got = substring_dedup.find_spans(df).select("text", "n_removed").collect()
        assert sorted(map(tuple, got)) == sorted([(b, 0), (a, 40), (a, 40)])


def test_every_labelled_language_is_learned(spark):
    word = lambda lang, k: "".join(chr(97 + (lang * 7 + k * j + k) % 26) for j in range(5))
    rows = [(f"{lang * 40 + k}", " ".join(word(lang, k + j) for j in range(20)), f"a{lang:02}") for lang in range(70) for k in range(3)]
    rows += [(f"z{k}", "的一是不了人我在有他这为之大来以个中上们" + "到说国和地也子时道出而要于就下得可你年生"[k:], "zh") for k in range(20)]
    rows += [(f"y{k}", "ωψχφυτσρποξνμλκιθηζεδγβα " * 900, "el") for k in range(10)]  # only long texts
    rows += [("new1", "人我在有他这为之大来以个", None), ("new2", "ωψχφυτσρπ οξνμλκιθ", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert got["new1"] == "zh" and got["new2"] == "el" and got["z3"] == "zh"


def test_blocks_of_languages_give_the_same_code_lengths():
    samples = {"x": [b"abracadabra abra"], "y": [b"zzz zyz"], "z": [b"qqq q", "é".encode()]}
    text = np.frombuffer(b"abra zq", np.uint8)
    whole = language_id.train(samples)
    assert len(language_id.train_blocks(samples)) == 1
    blocks = language_id.train_blocks(samples, block_cells=1)
    assert [m.langs for m in blocks] == [["x"], ["y"], ["z"]]
    apart = [language_id.code_lengths(m, text, np.array([0, len(text)]))[0, 0] for m in blocks]
    assert apart == pytest.approx(language_id.code_lengths(whole, text, np.array([0, len(text)]))[0])


def test_blocks_of_languages_give_the_same_predictions(spark):
    samples = {"x": [b"abracadabra abra"], "y": [b"zzz zyz"], "z": [b"qqq q"]}
    df = spark.createDataFrame([(1, "abra"), (2, "zz"), (3, "q qq"), (4, "1"), (5, None), (6, "")], "doc_id long, text string")
    one, three = (sorted(map(tuple, language_id.predict(df, language_id.train_blocks(samples, c), keep=["doc_id"]).collect())) for c in (language_id.BLOCK_CELLS, 1))
    assert [r[:2] for r in one] == [r[:2] for r in three] == [(1, "x"), (2, "y"), (3, "z"), (4, "und"), (5, "und"), (6, "und")]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in three])


def test_open_heads_and_open_elements_take_no_text_along():
    article = "<article><h1>A title</h1><p>One two three, four five six, seven eight nine.</p><p>Next paragraph is here, too.</p></article>"
    head = "<html><head><meta charset=utf-8><link rel=x href=y><title>x</title><script>var a;</script><style>p {}</style>"
    runs = lambda source: [t for _, t in html_extract.parse(source).runs]
    expected = ["A title", "One two three, four five six, seven eight nine.", "Next paragraph is here, too."]
    for start in (head, head + "</head><body>", head + "<body>", "<html><title>x</title>", "<head><title>x</head><body>", "<head><noscript><link href=x>", "<head><title>x"):
        assert runs(start + article) == expected, start
    for tag in ("noscript", "svg", "math", "select", "video"):
        assert runs(f"<body><{tag}>{article}") == expected, tag
        assert runs(f"<body><{tag}>hidden</{tag}>{article}") == expected, tag
    assert runs("<head>Stray words<p>and more") == ["Stray words", "and more"]
    assert runs("<p>shown<script>x" + article) == runs("<p>shown<textarea>x") == ["shown"]
    page, bare = html_extract.parse(head + "</head><body>" + article), html_extract.parse("<body>" + article)
    assert (page.tags, page.kind) == (bare.tags, bare.kind)
    opened, closed = html_extract.main_text([head + article, head + "</head><body>" + article], html_extract.train())
    assert opened == closed and opened.endswith("\n".join(expected[1:]))


def test_every_run_every_item_and_every_leaking_row_counts(spark):
    item, other, nameless = unlike("i", 38), unlike("o", 30), unlike("n", 20)
    twice = unlike("x", 10) + changed(item, *range(15, 23))
    rows = [(1, twice), (None, unlike("p", 9) + other), (None, unlike("q", 40)), (2, unlike("r", 5) + nameless), (3, unlike("s", 40)), (3, unlike("t", 4) + other), (4, None)]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (None, " ".join(nameless)), (None, " ".join(unlike("m", 20)))], "item_id long, text string")
    found = {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()}
    assert found == {(1, 0, 10, 25, 0, 15, 15), (1, 0, 33, 48, 23, 38, 15), (None, 1, 9, 39, 0, 30, 30), (2, None, 5, 25, 0, 20, 20), (3, 1, 4, 34, 0, 30, 30)}
    for options in ({}, {"block_items": 1}):
        left = decontamination.decontaminate(docs, bench, **options)
        assert left.columns == docs.columns
        assert sorted(str((r["doc_id"], (r["text"] or "?")[0])) for r in left.collect()) == ["(3, 's')", "(4, '?')", "(None, 'q')"]


def test_the_language_stage_rejects_only_undetermined_documents(spark):
    sisters = {"aa": "la casa e il mare", "bb": "la casa y el mar", "cc": "la casa e o mar"}
    rows = [(i, sisters[lang].split() * 5, lang) for i, lang in enumerate(sorted(sisters) * 20)] + [(100, ["la"], "aa"), (101, ["casa"], None), (102, ["12"], "aa"), (103, None, None)]
    df = spark.createDataFrame([(i, None if t is None else " ".join(t), lang, "s", 1) for i, t, lang in rows], DOCS)
    scores = {r["doc_id"]: r["score"] for r in language_id.identify(df).collect()}
    assert 0 < scores[100] < 0.5 and 0 < scores[101] < 0.5
    kept = corpus_pipeline.identify_language(spark, df, "").collect()
    assert {r["doc_id"] for r in kept} == {*range(60), 100, 101} and all(r["lang"] for r in kept)
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, bare, "").count() == len(rows)
