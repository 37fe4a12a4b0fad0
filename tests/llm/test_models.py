"""The learned operators against plain versions of their statistics, and their edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import language_id, quality_classifier


def fold(text):
    return [32 if b in (9, 10, 11, 12, 13) else 48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in text]


def plain_bits(training, all_training, text, order):
    """Code length of a text by PPM with escape method C and exclusions, byte by byte from counts of strings."""
    counts = defaultdict(Counter)
    for t in training:
        s = [32] * order + fold(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts[tuple(s[i - o : i])][s[i]] += 1
    alphabet = {b for t in all_training for b in fold(t)}
    n_symbols = len(alphabet) + 1
    s, bits = [32] * order + fold(text), 0.0
    for i in range(order, len(s)):
        ruled_out, byte = set(), s[i] if s[i] in alphabet else None
        for o in range(order, -1, -1):
            own = {b: n for b, n in counts[tuple(x if x in alphabet else None for x in s[i - o : i])].items() if b not in ruled_out}
            if not own:
                continue
            total, distinct = sum(own.values()), len(own)
            if byte in own:
                bits += math.log2((total + distinct) / own[byte])
                break
            bits += math.log2((total + distinct) / distinct)
            ruled_out |= set(own)
        else:
            bits += math.log2(max(1, n_symbols - len(ruled_out)))
    return bits


def test_code_lengths_equal_plain_ppm():
    r = random.Random(5)
    samples = {"x": [b"abracadabra abra", b"the cat sat on the mat", b"Cabra 12"], "y": ["zzz zyz été".encode(), b"a zebra, the zoo"]}
    everything = [t for v in samples.values() for t in v]
    model = language_id.train(samples)
    texts = [b"abra", b"zz", b"q", b"A\tzoo 9", "été".encode(), b"the zebra sat", b""] + [bytes(r.choice(b"abcdehrtz q\n7") for _ in range(r.randint(1, 30))) for _ in range(40)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    got = language_id.code_lengths(model, flat, np.cumsum([0, *map(len, texts)]))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx([plain_bits(samples[k], everything, text, language_id.ORDER) for k in model.langs], rel=1e-5, abs=1e-6), text


LANG = "lang_pred int, doc_id long, text string, lang string, c0 string"


def test_language_columns_repeated_ids_long_texts_and_empty_tables(spark):
    rows = [(7, 5, f"the cat and the dog {i}", "en", "x") for i in range(2_000)] + [(7, i, "der hund und die katze", "de", None) for i in range(10, 40)] + [(7, 90, "la casa " * 40_000, None, "y"), (None, None, "und der hund", None, None)]
    df = spark.createDataFrame(rows, LANG)
    texts = language_id.sample(df, F.col("lang"), F.lit(True), "doc_id", "text")
    assert texts["en"] == [b"the cat and the dog 0"] and len(texts["de"]) == 30
    found = language_id.identify(df, train_on=F.lit(True))
    assert found.columns == ["doc_id", "text", "lang", "c0", "lang_pred", "score"] and found.count() == len(rows)
    assert {r["lang_pred"] for r in found.where("doc_id = 10 OR doc_id IS NULL").collect()} == {"de"}
    assert language_id.identify(df.limit(0)).count() == 0
    assert language_id.predict(df.limit(0), language_id.learn(df, train_on=F.lit(True))).count() == 0


def test_sample_is_the_lowest_hashes_of_each_language(spark):
    df = spark.range(0, 9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 9 == 0, "aa").when(F.col("id") % 900 == 1, "bb").otherwise("cc").alias("lang"))
    got = language_id.sample(df, F.col("lang"), F.lit(True), "doc_id", "text", docs_per_lang=50)
    assert {k: len(v) for k, v in got.items()} == {"aa": 50, "bb": 10, "cc": 50}
    ranked = df.where("lang = 'cc'").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(50)
    assert sorted(got["cc"]) == sorted(r["text"].encode() for r in ranked.collect())


def plain_sites(labelled):
    """Posteriors by host and path, counted in plain Python."""

    def strength(groups, mean):
        some = [(n, b, m) for n, b, m in groups if n >= 2]
        d, v, w = (sum(f(n, b, m) for n, b, m in some) for f in (lambda n, b, m: n * (b / n - m) ** 2, lambda n, b, m: m * (1 - m), lambda n, b, m: (n - 1) * m * (1 - m)))
        excess = (d - v) / w if w else 0
        return min(max((1 - excess) / excess, quality_classifier.LEAST_STRENGTH), quality_classifier.MOST_STRENGTH) if d and excess > 0 else quality_classifier.MOST_STRENGTH

    hosts, paths = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, path, bad in labelled:
        for table, key in ((hosts, host), (paths, (host, path))):
            table[key][0] += 1
            table[key][1] += bad
    rate = (sum(b for _, b in hosts.values()) + 1) / (len(labelled) + 2)
    k = strength([(n, b, rate) for n, b in hosts.values()], rate)
    host_rate = {h: (b + k * rate) / (n + k) for h, (n, b) in hosts.items()}
    k = strength([(n, b, host_rate[h]) for (h, _), (n, b) in paths.items()], None)
    return rate, host_rate, {(h, p): (b + k * host_rate[h]) / (n + k) for (h, p), (n, b) in paths.items()}


def test_classifier_combines_evidence_as_by_hand(spark):
    r = random.Random(6)
    words = lambda bad: " ".join(r.choice("alpha beta gamma delta".split() + ["nasty"] * 2 * bad) for _ in range(30))
    rows, labels = [], []
    for i in range(900):
        host, path = f"h{i % 7}", f"p{i % 3}"
        bad = r.random() < (0.1 + 0.12 * (i % 7)) * (0.5 + 0.4 * (i % 3))
        rows.append((i, words(bad), path if i % 11 else None, host))
        if i % 4:
            labels.append((i, 1 - int(bad), 0))
    rows += [(900, words(0), "p0", "unknown host"), (901, words(0), "unknown path", "h1"), (902, None, None, None), (5, words(1), "p2", "h5"), (903, "nasty " * 50_000, "p1", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels + labels[:9] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    known = {i: 1 - q for i, q, _ in labels}
    rate, hosts, paths = plain_sites([(s or "", p or "", known[i]) for i, _, p, s in rows if i in known])
    logit = lambda p: math.log(p / (1 - p))
    found = quality_classifier.classify(df, lab).collect()
    assert len(found) == len(rows)
    for f in found:
        host, path = f["source"] or "", f["lang"] or ""
        site = paths.get((host, path), hosts.get(host, rate))
        assert f["p_site"] == pytest.approx(site, rel=1e-9)
        z = logit(f["p_document"]) + logit(site) - logit(rate)
        assert f["p_bad"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and f["kept"] == (f["p_bad"] < 0.5)
    empty = quality_classifier.classify(df.limit(0), lab)
    assert empty.count() == 0 and quality_classifier.classify(df, lab.limit(0)).where("kept AND p_bad = 0.5").count() == len(rows)


def test_classifier_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "h", 3, 4, "x"), (1, "a b c", "en", "h", 3, 4, "x")], "doc_id long, text string, lang string, source string, kept int, bad int, __host string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_classifier.classify(df, lab)
    assert found.columns == ["doc_id", "text", "lang", "source", "bad", "__host", "p_document", "p_site", "p_bad", "kept"]
    assert [(r["bad"], r["__host"], r["kept"]) for r in found.collect()] == [(4, "x", True)] * 2


def test_languages_whose_rows_share_an_id_are_learned(spark):
    rows = [(i, " ".join(("der", "hund", "und", "die", "katze")[(i + k) % 5] for k in range(30)), "de") for i in range(200)] + [(i, " ".join(("the", "dog", "and", "a", "cat")[(i + k) % 5] for k in range(30)), "en") for i in range(200, 400)]
    shared = [i for i in range(900_000, 900_040) if zlib.crc32(str(i).encode()) % 5][:8]
    for n, i in enumerate(shared):  # a language each, of 300 rows under one id
        rows += [(i, " ".join(f"{chr(0x3B1 + n)}{chr(0x3B1 + n)}{k + r % 7}" for k in range(20)), f"x{n}") for r in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.sample(df, F.col("lang"), ~language_id.held_out(), "doc_id", "text", docs_per_lang=20)
    assert set(samples) == {"de", "en", *(f"x{n}" for n in range(8))} and all(len(v) == 1 for k, v in samples.items() if k[0] == "x")
    assert 20 >= len(samples["de"]) > 10
    got = language_id.identify(df.dropDuplicates(["doc_id"])).where("doc_id >= 900000").collect()
    assert len(got) == 8 and all(r["lang_pred"] == r["lang"] for r in got)
