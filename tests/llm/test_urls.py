"""The path-template tree against its SQL, deep paths, and edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ridgeline.llm import queries, url_filters
from ridgeline.llm.lineage import cut


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def by_sql(urls):
    import duckdb
    import pandas

    con = duckdb.connect()
    con.register("pages", pandas.DataFrame({"page_id": range(len(urls)), "url": urls}))
    return {r[0]: r[1:] for r in con.sql(queries.op8_sql()).fetchall()}


def urls():
    r = random.Random(9)
    out = [None, "no scheme", "http://", "HTTPS://EXAMPLE.com/en/7?x", "http://a.example.net//de/8", "http://x.org/es", "http://x.org/es/"]
    for _ in range(1_500):
        host = r.choice(["a.com", "b.com", "example.com", "c.net", "example.net", "d.org", "h.test"])
        segments = [r.choice(["en", "de", "es", "x"]), *(r.choice(["news", "tag", "p", f"{r.randint(0, 99)}", f"post-{r.randint(0, 30)}", f"{r.getrandbits(48):012x}", "", f"w{'abcdefgh'[r.randint(0, 7)]}"]) for _ in range(r.randint(0, 5)))]
        out.append(f"http://{host}/{'/'.join(segments)}{r.choice(['', '/', '?q=1', '#x'])}")
    return out


def test_the_tree_equals_its_sql(spark):
    cases = urls()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages(spark, cases)).collect()}
    expected = by_sql(cases)
    assert got == expected
    assert {"allow", "block"} == {v[3] for v in got.values()}


def test_paths_branch_at_any_depth(spark):
    deep = "/".join(f"s{chr(97 + i % 26)}" for i in range(9))
    rows = [(f"http://h.test/{deep}/bad/{i}", 0) for i in range(12)] + [(f"http://h.test/{deep}/good/{i}", 1) for i in range(12)] + [(f"http://h.test/{deep}/bad/99", None), (f"http://h.test/{deep}/good/99", None), ("http://h.test/" + "a/" * 3_000, None)]
    df = spark.createDataFrame(rows, "url string, good int")
    got = {r["url"]: (r["verdict"], r["template"]) for r in url_filters.judge(df, rules=(), good=F.col("good")).collect()}
    assert all(v == ("block" if "/bad/" in u else "allow") for u, (v, _) in got.items())
    assert got[f"http://h.test/{deep}/bad/99"][1] == f"h.test/{deep}/bad/{{n}}"


def test_shared_segments_are_passed_at_once(spark, monkeypatch):
    # the SQL walks four levels; empty segments let different prefixes meet
    r = random.Random(4)
    cases = []
    for _ in range(1_200):
        middle = r.choice(["a//b/c", "a/b//c", "a//b//", "a/b/c", "", "/", "x/y/z"])
        cases.append(f"http://{r.choice(['p.com', 'q.net', 'example.com', 'u.org'])}/{r.choice(['en', 'de', 'es'])}/{middle}{r.choice(['', '/', f'/{r.choice(list('abcdefgh'))}'])}")
    got = {row["page_id"]: (row["host"], row["path"], row["rule"], row["verdict"]) for row in url_filters.judge(pages(spark, cases)).collect()}
    assert got == by_sql(cases)
    written = []
    monkeypatch.setattr(url_filters, "cut", lambda df: written.append(1) or cut(df))
    steps = {}
    for n in (3, 300):
        written.clear()
        shared = "http://h.test/" + "/".join(f"s{chr(97 + i % 26)}" for i in range(n))
        rows = [(f"{shared}/bad/{i}", 0) for i in range(9)] + [(f"{shared}/good/{i}", 1) for i in range(9)]
        found = url_filters.judge(spark.createDataFrame(rows, "url string, good int"), rules=(), good=F.col("good")).collect()
        assert all(row["verdict"] == ("block" if "/bad/" in row["url"] else "allow") for row in found)
        steps[n] = len(written)
    assert steps[3] == steps[300]


def test_ties_repeated_rows_clashing_columns_and_empty_tables(spark):
    names = ("rejected", "shape", "n_labels", "template", "segments", "__good", "prefix")
    rows = [("http://h.test/spam/1", 1, 0)] * 6 + [("http://h.test/fine/1", 2, 1)] * 6 + [(None, 3, None)]
    df = spark.createDataFrame(rows, "url string, page_id int, good int").withColumns({n: F.lit(n) for n in names})
    found = url_filters.judge(df, rules=(), good=F.col("good"))
    assert found.columns == ["url", "page_id", "good", *(n for n in names if n != "template"), "host", "path", "rule", "verdict", "template", "purity"]
    assert sorted((r["page_id"], r["verdict"], r["rejected"], r["shape"]) for r in found.collect()) == [(1, "block", "rejected", "shape")] * 6 + [(2, "allow", "rejected", "shape")] * 6 + [(3, "allow", "rejected", "shape")]
    assert url_filters.judge(df.limit(0)).count() == 0
