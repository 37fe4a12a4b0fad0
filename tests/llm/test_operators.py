"""Each operator against a plain version of itself, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, html_extract, language_id, lineage, ngram_jaccard, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, textkit, token_counts, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    out = [None, "", "  \n\t ", "one", "a b c", prose(35), prose(9_000)]
    for i in range(60):
        text = prose(r.randint(20, 200))
        out.append(text)
        if i % 4 == 0:
            out.append(text)  # an exact copy
        if i % 5 == 0:
            w = text.split()
            w[len(w) // 2] = "changed"
            out.append(" ".join(w))  # a near copy
        if i % 6 == 0:
            out.append(prose(30) + "\n" + passage + " " + prose(30))
        if i % 10 == 0:
            out.append(text + " " + text)
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 3}", 7) for i, t in enumerate(out)]
    return rows + [rows[9], (None, "an id is missing here", None, None, None)]  # a repeated row, a null id


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_words_across_pieces():
    texts = ["a b  c", "", None, "\x0bx\ty ", "é", "a b"]
    for most in (1, 4, 1000):
        got = [[bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(w.first[k], w.first[k + 1])] for w in textkit.words(textkit.utf8(pa.array(texts)), most) for k in range(len(w))]
        assert got == [words(t) for t in texts]


def test_substring_dedup(spark, corpus):
    counts = collections.Counter(tuple(w[i : i + 35]) for _, t, *_ in corpus for w in [words(t)] for i in range(len(w) - 34))
    expected = []
    for i, t, *_ in corpus:
        w = words(t)
        gone = {k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.find_spans(frame(spark, corpus)).select("doc_id", "n_words", "n_removed", "kept_text", "spans").collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:4]) for r in got)
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.find_spans(frame(spark, [])).count() == 0


def test_quality_rules(spark, corpus):
    def brute(t):
        t = t or ""
        w = words(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        longest = 0
        for k in range(8, len(w)):
            if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) == len(w) - k + 1:
                break
            longest = k
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        over = 100 * len(covered) > 25 * len(w) or longest > max(64, len(w) * 20 // 100)
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), longest, failed, not failed and not over)

    rows = [*corpus, (500, "a b " * 40, None, None, None), (501, "# x\n# x\n\n\n$y", None, None, None), (502, "q r s t u v w x y z " * 3 + "é|", None, None, None)]
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    got = quality_rules.apply_rules(frame(spark, rows)).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
    assert sorted(str((i, *brute(t))) for i, t, *_ in rows) == sorted(str(tuple(r)) for r in got)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.load_vocabulary(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def test_codec_equals_the_library(spark, corpus, vocabulary):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r, parts = random.Random(1), list("aab  \n\t▁éß😀中<0x41>s\x00bcthe　") + ["the", "ing", "  "]
    rows = corpus + [(900 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 60))), None, None, None) for i in range(300)] + [(2_000, "a" * 3_000, None, None, None)]
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_decode(frame(spark, rows), vocabulary).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert list(got[i]["ids"]) == ids and got[i]["decoded"] == library.decode(ids), repr(t)


def test_token_counts_equal_plain_viterbi(spark, corpus, vocabulary):
    costs = {p: int(-s) for p, s, k in zip(vocabulary["pieces"], vocabulary["scores"], vocabulary["kinds"], strict=True) if k == "normal"}
    unknown = max(costs.values()) + 10

    def plain(text):
        if not text:
            return 0, 0
        t = ("▁" + text.replace(" ", "▁"))
        best = [(0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            for b in range(max(0, e - 20), e):
                if (c := costs.get(t[b:e])) is not None and (best[e] is None or best[b][0] + c < best[e][0]):
                    best[e] = (best[b][0] + c, best[b][1] + 1)
            if t[e - 1] not in costs and (best[e] is None or best[e - 1][0] + unknown < best[e][0]):
                best[e] = (best[e - 1][0] + unknown, best[e - 1][1] + len(t[e - 1].encode()))
        return best[-1][1], best[-1][0]

    rows = [r for r in corpus if len(r[1] or "") < 20_000] + [(901, "ünï\n😀 x\t\ty  z", None, None, None)]
    for r in token_counts.count_tokens(frame(spark, rows), vocabulary).collect():
        assert (r["n_tokens"], -r["score"]) == plain(r["text"])


def test_decontamination(spark):
    r = random.Random(2)
    prose = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    items = [prose(40), prose(15), ["only", "five", "words", "stand", "here"], prose(30)]
    changed = list(items[3])
    changed[7] = changed[19] = "else"
    docs = [(0, " ".join(prose(50) + items[0] + prose(9))), (1, " ".join(items[1]).upper()), (2, "x Only five words stand here y"), (3, " ".join(prose(20) + changed)), (4, " ".join(prose(300))), (5, " ".join(prose(20) + items[0][:12] + prose(20))), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.find_leaks(df, bench).collect()}
    assert found == {(0, 0, 40), (1, 1, 15), (2, 2, 5), (3, 3, 28)}
    assert {tuple(r)[:2] for r in decontamination.find_leaks(df, bench, block_items=1).collect()} == {f[:2] for f in found}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()) == [4, 5, 6, 7]
    assert decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_ngram_jaccard(spark, corpus):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in corpus:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for options in ({}, {"bits": 4}, {"bits": 4, "hot_count": 1}):
        got = ngram_jaccard.join_components(frame(spark, corpus), **options).collect()
        assert len(got) == len(corpus)
        for r in got:
            expected = None if r["doc_id"] is None else root(r["doc_id"])
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), expected)
    assert ngram_jaccard.join_components(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["id"]: r["component"] for r in lineage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


def test_language_id(spark):
    r = random.Random(3)
    parts = {"aa": "the and ing er tion".split(), "bb": "der und sch keit ung".split()}
    text = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(60))
    rows = [(i, text(k), k if i % 7 else None, None, None) for i in range(200) for k in [("aa", "bb")[i % 2]]] + [(1_000, None, "aa", None, None), (1_001, "12 !", "bb", None, None), (1_002, "", None, None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == ("aa", "bb")[i % 2] and 0.5 < got[i]["score"] <= 1 for i in range(200))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1_000, 1_001, 1_002))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, [(1, "some text", None, None, None)])).collect()} == {"und"}


def test_code_lengths_are_those_of_the_tree():
    model = language_id.train({"x": [b"abracadabra abra"], "y": [b"zzz zyz"]})
    bits = model.bits.reshape(-1, model.n_symbols, 2)
    assert np.isfinite(bits).all()
    for text in (b"abra", b"zz", b"q"):
        whole = language_id.code_lengths(model, np.frombuffer(text + b"zy", np.uint8), np.array([0, len(text), len(text) + 2]))
        alone = language_id.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert whole[0] == pytest.approx(alone[0])
    assert language_id.code_lengths(model, np.frombuffer(b"abra", np.uint8), np.array([0, 4]))[0].argmin() == 0


def test_html_extraction():
    trees = html_extract.train()
    exact = 0
    for seed in range(50_000, 50_100):
        source, blocks = html_extract.training_page(seed)
        exact += html_extract.main_text([source], trees)[0] == "\n".join(blocks)
    assert exact >= 85
    page = '<html><nav><a href=x>Menu</a> <a>Two</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three, four five six.<p>Next <i>para</i>graph is here, too.</article><div class="comments"><p>Nice!</p></div><footer>&copy; me</footer>'
    assert html_extract.main_text([page, None, "", "<script>x"], trees) == ["A & B\nOne two three, four five six.\nNext paragraph is here, too.", "", "", ""]


def test_html_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<article><p>Some words stand here, in a row.</p></article>", "old")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == "" and html_extract.extract(df).columns == ["page_id", "html", "text"]


def test_quality_classifier(spark):
    r = random.Random(4)
    clean = lambda: " ".join(f"w{r.randint(0, 300)}" for _ in range(80))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, clean() + (" Nasty! rude" if bad else ""), "en", f"host{i % 4}", None))
        labels.append((i, 0 if bad and i % 2 else 1, 1 if bad and not i % 2 else 0))
    rows += [(1_000, None, None, None, None), (1_001, "", "en", "new", None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(frame(spark, rows), lab, train_on=F.expr("doc_id % 3 <> 0")).collect()
    test = [r for r in got if r["doc_id"] < 600 and r["doc_id"] % 3 == 0]
    assert len(got) == len(rows) and sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in test) / len(test) > 0.97
    assert all(r["kept"] and r["p_bad"] == 0.5 for r in quality_classifier.classify(frame(spark, rows[:3]), lab.limit(0)).collect())


def test_site_rates_shrink(spark):
    labelled = [("big", "a", int(i % 2)) for i in range(400)] + [("clean", "a", 0) for _ in range(400)] + [("tiny", "a", 1)]
    hosts, paths, rate = quality_classifier.site_posteriors(spark.createDataFrame(labelled, "host string, path string, bad int"))
    got = {r["host"]: r["host_rate"] for r in hosts.collect()}
    assert abs(got["big"] - 0.5) < 0.05 and got["clean"] < 0.05 and rate < got["tiny"] < 0.9 and paths.count() == 3


def test_url_rules(spark):
    cases = {
        "http://a.example.com/en/1": ("com/en/", "block"), "http://x.example.com/en/77?q": ("example.com/en/7", "allow"), "https://EXAMPLE.net/de/8#x": ("example.net/de/8", "block"), "https://b.net/de/1": ("net/de/", "allow"),
        "ftp://org/es/": ("org/es/", "block"), "http://notorg/es/1": (None, "allow"), "http://a.com": (None, "allow"), "nonsense": (None, "allow"), None: (None, "allow"), "http://xcom/en/": (None, "allow"), "http://a.com/EN/1": (None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    parts = {r["page_id"]: (r["host"], r["path"]) for r in url_filters.judge(df).collect()}
    assert parts[2] == ("example.net", "/de/8") and parts[7] == ("", "") and parts[6] == ("a.com", "")


def test_template_purity(spark):
    rows = [(f"http://h.test/spam/{i}", 0) for i in range(20)] + [(f"http://h.test/news/{i}/x", 1) for i in range(20)] + [("http://h.test/spam/999", None), ("http://h.test/news/5/x", None), ("http://h.test/other", None)]
    df = spark.createDataFrame(rows, "url string, good int")
    got = [(r["url"], r["verdict"]) for r in url_filters.judge(df, rules=(), good=F.col("good")).collect()]
    assert all(v == ("block" if "/spam/" in u else "allow") for u, v in got) and len(got) == len(rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    lang = {"aa": "the and ing er tion".split(), "bb": "der und sch keit ung".split()}
    text = lambda k, n: " ".join("".join(r.choice(lang[k]) for _ in range(r.randint(2, 5))) for _ in range(n))
    item, passage = text("aa", 20), text("bb", 50)
    rows = [(i, text(("aa", "bb")[i % 2], 80), ("aa", "bb")[i % 2], "s", 1) for i in range(60)]
    rows += [(60, rows[3][1], "bb", "s", 1), (61, text("aa", 30) + " " + item, "aa", "s", 1), (62, "123", None, "s", 1), (63, text("bb", 60) + " " + passage, "bb", "s", 1), (64, text("bb", 70) + " " + passage, None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(range(60)) | {63, 64} and len(words(got[63])) == 60 and len(words(got[64])) == 70
    final = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()}
