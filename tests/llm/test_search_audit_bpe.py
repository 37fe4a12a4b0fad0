"""Lexical search, filter audit and byte-level BPE against plain versions and the library, on nulls, ties, long texts, repeated rows and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import byte_bpe_codec, filter_audit, lexical_search
from ridgeline.llm import queries as q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("id", "part", "mask", "n", "same", "apart", "good", "toxic", "term", "shard", "item", "rank", "score", "c0", "ids", "decoded")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdEé1") for _ in range(r.randint(1, 4))) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + r.choice(["", "!", " #1", " A|B"])
    texts = [None, "", " \n\t ", "?!", "one", "É ÉÉ é", prose(30_000), "THE QUICK BROWN FOX " * 40, *(prose(r.randint(1, 160)) for _ in range(150))]
    texts += [texts[20]] * 6 + [texts[21], texts[22], None, ""]
    r.shuffle(texts)
    out = [(i, t, [None, "", "en", "de"][i % 4], "own") for i, t in enumerate(texts)]
    return [*out, out[30], out[31], out[31], (None, texts[20], "en", None), (None, prose(50), None, None), (None, prose(50), None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("own") for c in CLASHING}).repartition(5).cache()


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def ranked(rows, queries, k):
    """A plain search: item -> (rank, id, score)."""
    held = [(i, terms(t)) for i, t, *_ in rows if terms(t)]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for item, text in queries:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for i, t in held:
            m = 10 + (90 * len(t) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in own if x in df)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


def test_integers_survive_packing():
    for values in ([], [0], [127, 128, 0, 1 << 40, 16_383, 16_384], list(range(300))):
        packed, ends = lexical_search.pack(np.array(values, np.int64))
        assert lexical_search.unpack(packed.tobytes()).tolist() == values and len(ends) == len(values)


@pytest.mark.parametrize(("shard_bytes", "k"), [(1 << 30, 10), (3_000, 3), (1, 10)])
def test_search_equals_plain_search(spark, rows, docs, shard_bytes, k):
    r = random.Random(8)
    asked = [(i, " ".join(r.sample(terms(rows[j][1]), min(6, len(terms(rows[j][1])))))) for i, j in enumerate(range(0, len(rows), 7))]
    asked += [(900, None), (901, "?!"), (902, "unheard of"), (3, "the quick"), (3, "fox"), (None, "brown é"), (903, rows[6][1])]
    queries = spark.createDataFrame(asked, "item_id int, text string").withColumn("term", F.lit(1))
    got = [tuple(x) for x in lexical_search.search(lexical_search.build(docs, shard_bytes=shard_bytes), queries, k).collect()]
    assert sorted(got, key=repr) == ranked(rows, asked, k)


def test_search_in_blocks_and_of_nothing(spark, rows, docs):
    asked = [(i, rows[i][1]) for i in range(0, 60, 5)]
    queries = spark.createDataFrame(asked, "item_id int, text string")
    index = lexical_search.build(docs)
    got = [tuple(x) for x in lexical_search.search(index, queries, most_queries=2, most_terms=50).collect()]
    assert sorted(got, key=repr) == ranked(rows, asked, 10)
    assert lexical_search.search(index, queries.limit(0)).count() == 0
    assert lexical_search.rank_documents(docs.limit(0), queries).count() == 0
    assert lexical_search.rank_documents(docs.where("text IS NULL OR text = ''"), queries).count() == 0


def test_skipped_lists_change_nothing():
    r = random.Random(2)
    for _ in range(300):
        lists, total = [], {}
        for _ in range(r.randint(0, 6)):
            own = object.__new__(lexical_search._List)
            own.docs = sorted(r.sample(range(60), r.randint(1, 60)))
            own.adds = [r.choice([0, 1, 2, 3, 50]) for _ in own.docs]
            own.best = max(own.adds)
            lists.append(own)
            for d, a in zip(own.docs, own.adds, strict=True):
                total[d] = total.get(d, 0) + a
        want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:4]
        assert sorted(lexical_search.best_documents(lists, 4), key=lambda x: (-x[0], x[1])) == want


def audited(rows, labels):
    """A plain audit, order by order and document by document."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts, out = {}, []
    for i, t, lang, *_ in rows:
        text, w = t or "", WORD.findall(t or "")
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]), strict=True) if x}
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    for part, held in parts.items():
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(held)
            for step, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                removed[f] = removed.get(f, 0) + len(gone)
                out.append([part, order, step + 1, len(left), len(gone), sum(f in d[0] for d in held) - len(gone), sum(d[0] == {f} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        for row in out:
            if row[0] == part:
                row.append(removed[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def test_audit_equals_plain_audit(spark, rows, docs):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(6, None, 1), (6, 1, None), (None, 1, 1), (10_000, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    got = filter_audit.audit_texts(docs, frame)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_audit_of_other_filters_and_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_texts(docs.limit(0), labels).count() == 0
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"))
    counts = filter_audit.mask_counts(df, labels, {"p": F.col("doc_id") % 2 == 0, "q": F.when(F.col("doc_id") > 5, F.col("doc_id") % 3 == 0)})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(filter_audit.survivors(counts, 2), "pq").collect()}
    p, qq = {i for i in range(100) if i % 2 == 0}, {i for i in range(6, 100) if i % 3 == 0}
    assert got[("pq", 1)] == (50, 50, 0, len(p - qq), 50 + len(p - qq))
    assert got[("pq", 2)] == (50 - len(qq - p), len(qq - p), len(qq & p), len(qq - p), len(qq) + len(qq - p))
    assert got[("qp", 1)][:3] == (100 - len(qq), len(qq), 0) and got[("qp", 2)][1] == len(p - qq)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(q.BYTE_MODEL))


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe_codec.load_vocabulary(public_tokenizers.path(q.BYTE_MODEL))


def test_byte_bpe_equals_the_library(spark, rows, docs, vocab, library):
    got = byte_bpe_codec.encode_decode(docs, vocab, keep=["doc_id", "text", "ids", "source"]).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["ids"] == library.encode(x["text"] or "", add_special_tokens=False).ids and x["decoded"] == (x["text"] or "")
    packed = byte_bpe_codec.encode_decode(docs, vocab, keep=["text"], packed=True, decoded_col=None)
    assert packed.columns == ["text", "ids"]
    assert all(np.frombuffer(x["ids"], "<u4").tolist() == library.encode(x["text"] or "", add_special_tokens=False).ids for x in packed.collect())
    assert byte_bpe_codec.encode_decode(docs.limit(0), vocab).count() == 0


def test_byte_bpe_of_odd_texts(vocab, library):
    r = random.Random(4)
    signs = [*map(chr, range(0x180)), *"  \n'stremvld" * 5, " ", "　", "\x85", "😀", "你", "٣", "²", "‍", "\U00018e00", "\U0001e6e0", "\U00011de0", "՘", "<|endoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(4_000)] + ["a" * 4_000, " " * 900, "ab" * 3_000, "<|endoftext|>" * 2, "<|endoftext|", "x" + "\U00018e00" * 3 + " \n \n y"]
    codec = byte_bpe_codec.ByteBpeCodec(vocab)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == want.ids, text
        assert codec.decode(ids, np.array([len(ids)]))[0].tobytes().decode() == text


def test_byte_bpe_decodes_any_ids(spark, vocab, library):
    r = random.Random(6)
    lists = [[r.randrange(50_257) for _ in range(r.randint(0, 6))] + [r.randrange(256) for _ in range(r.randint(0, 4))] for _ in range(500)] + [[], None, [127], [228]]
    df = spark.createDataFrame(list(enumerate(lists)), "decoded int, ids array<int>").withColumn("c0", F.lit("own"))
    got = byte_bpe_codec.decode(df, vocab, text_col="text").collect()
    assert all(x["text"] == library.decode(x["ids"] or [], skip_special_tokens=False) and x["c0"] == "own" for x in got)
    with pytest.raises(Exception, match="outside of the vocabulary"):
        byte_bpe_codec.decode(spark.createDataFrame([([50_257],)], "ids array<int>"), vocab).collect()


def test_byte_bpe_forgets_when_full(vocab, library, monkeypatch):
    monkeypatch.setattr(byte_bpe_codec, "CACHE_TOKENS", 3)
    codec = byte_bpe_codec.ByteBpeCodec(vocab)
    for text in ("one two three four five", "five four three two one " * 3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(codec.known) <= 3


def test_vocabularies_that_are_not_implemented(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path(q.BYTE_MODEL), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "vocabulary.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            byte_bpe_codec.load_vocabulary(str(path))


def test_terms_across_pieces():
    texts = ["Ab c-d", None, "", "É1_x", "\x00z{", "a b"]
    want = [terms(t) for t in texts]
    column = pa.array(texts, pa.large_string()).fill_null("")
    hashes, first, _ = next(lexical_search.terms(column))
    assert np.diff(first).tolist() == [len(t) for t in want]
    flat = [t for own in want for t in own]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
