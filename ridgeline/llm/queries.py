"""The queries of this subpackage, and SQL for those that SQL can express.

Each query applies one operator, with its production parameters, to its whole
table, and derives the columns that its contract names from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import substring_dedup as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.find_spans(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import quality_rules as op

    return op.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"], spans_col=None).drop("longest_repeat")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import sentencepiece_codec as op

    found = op.encode_decode(table(spark, sf_dir, "documents"), op.load_vocabulary(tokenizer_path()), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import decontamination as op

    return op.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import html_extract as op

    found = op.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import ngram_jaccard as op

    return op.join_components(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import quality_classifier as op

    return op.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import url_filters as op

    return op.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import sentencepiece_codec, token_counts as op

    return op.count_tokens(table(spark, sf_dir, "documents"), sentencepiece_codec.load_vocabulary(tokenizer_path()), keep=["doc_id"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import language_id as op

    return op.identify(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", op.held_out().alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import lexical_search as op

    return op.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import filter_audit as op

    return op.audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import byte_bpe_codec as op

    found = op.encode_decode(table(spark, sf_dir, "documents"), op.load_vocabulary(tokenizer_path(BYTE_MODEL)), keep=["doc_id"], packed=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Words of a text, as a SQL list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
g AS (SELECT p.r, p.s, array_to_string(d.w[p.s:p.s + 34], ' ') AS k FROM p JOIN d USING (r)),
twice AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM g JOIN twice USING (k)),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r)
"""

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8),
g AS (SELECT p.r, p.s, array_to_string(d.w[p.s:p.s + 7], ' ') AS k FROM p JOIN d USING (r)),
twice AS (SELECT r, k FROM g GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS i FROM g JOIN twice USING (r, k)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
far AS (SELECT r, greatest(64, len(w) * 20 // 100) + 1 AS k FROM d),
long AS (SELECT DISTINCT r FROM (
  SELECT r, array_to_string(w[s:s + k - 1], ' ') AS x FROM (SELECT d.r, d.w, far.k, unnest(range(1, len(d.w) - far.k + 2)) AS s FROM d JOIN far USING (r) JOIN covered USING (r) WHERE len(d.w) > far.k)
) GROUP BY r, x HAVING count(*) > 1),
c AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, long.r IS NOT NULL AS too_long
  FROM d LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN long USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 25 * n_words OR too_long) AS kept
FROM c
"""


OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

def op8_sql(levels: int = 12) -> str:
    """The template tree, level by level; paths may branch down to this many levels (the operator has no such limit)."""
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""
e{k} AS (SELECT *, coalesce(segments[{k}], '') AS seg FROM s{k - 1}),
b{k} AS (SELECT host, prefix, seg, sum(n) AS n, sum(labels) AS labels, sum(goods) AS goods FROM e{k} GROUP BY ALL),
n{k} AS (SELECT host, prefix, count(*) AS children, sum(n) AS all_n, sum(labels) AS all_labels, sum(goods) AS all_goods FROM b{k} GROUP BY ALL),
t{k} AS (SELECT host, prefix, seg, CASE WHEN seg = '' THEN ''
    WHEN (labels > 0 AND all_labels - labels > 0 AND pow(abs(goods / labels - (all_goods - goods) / (all_labels - labels)), 2)
        <= 1.96 * 1.96 * (all_goods / all_labels * (1 - all_goods / all_labels)) * (1.0::DOUBLE / labels + 1.0::DOUBLE / (all_labels - labels)))
      OR (children > 16 AND n < 0.02 * all_n AND NOT starts_with(seg, '{{')) THEN '*'
    ELSE seg END AS branch FROM b{k} JOIN n{k} USING (host, prefix)),
s{k} AS (SELECT host, segments, n, labels, goods, CASE WHEN branch = '' THEN prefix ELSE prefix || '/' || branch END AS prefix FROM e{k} JOIN t{k} USING (host, prefix, seg))""")
    rules = "".join(f"\n    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}:{v}'" for h, p, r, v in OP8_RULES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM u),
r AS (SELECT *, CASE {rules} END AS found FROM p),
g AS (SELECT page_id, host, path, split_part(found, ':', 1) AS rule, split_part(found, ':', 2) AS given,
  string_split(regexp_replace(array_to_string([CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{{8,}}') AND regexp_matches(x, '[0-9]') THEN '{{x}}' ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END FOR x IN regexp_extract_all(path, '[0-9A-Za-z]+|[^0-9A-Za-z]+')], ''), '^/', ''), '/') AS segments FROM r),
s0 AS (SELECT host, segments, count(*)::DOUBLE AS n, count(given)::DOUBLE AS labels, coalesce(sum((given = 'allow')::INT), 0)::DOUBLE AS goods, '' AS prefix FROM g WHERE host <> '' GROUP BY host, segments),{",".join(steps)},
leaves AS (SELECT host, prefix, sum(labels) >= 5 AND (sum(goods) + 1) / (sum(labels) + 2) < 0.3 AS rejected FROM s{levels} GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN (SELECT host, segments, rejected FROM s{levels} JOIN leaves USING (host, prefix)) USING (host, segments)
"""


def _terms(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS t FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
m AS (SELECT r, doc_id, 10 + (90 * len(t)::BIGINT * docs) // terms AS m FROM d, s WHERE len(t) > 0),
f AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 10
"""

OP12_SQL = rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM f LEFT JOIN g USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
y AS (SELECT part, filter_order, good, toxic, fails, coalesce(list_min([strpos(filter_order, c) FOR c IN string_split(fails, '') IF c <> '']), 9) AS gone FROM x, o),
z AS (SELECT part, filter_order, unnest(range(1, 6)) AS step, substr(filter_order, step::INT, 1) AS own, good, toxic, fails, gone FROM y),
a AS (SELECT part, filter_order, step, own, count_if(gone > step) AS kept, count_if(gone = step) AS removed, count_if(gone < step AND contains(fails, own)) AS redundant,
  count_if(fails = own) AS unique_fails, count_if(gone = step AND good) AS good_lost, count_if(gone = step AND toxic) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""

#: Host, path, rule and verdict; the longest first. Fixed values.
OP8_RULES = (("example.com", "/en/7", "example.com/en/7", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("com", "/en/", "com/en/", "block"), ("net", "/de/", "net/de/", "allow"), ("org", "/es/", "org/es/", "block"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_quality_rules, op3_sentencepiece, op4_decontamination, op5_html_extract, op6_ngram_jaccard, op7_quality_classifier, op8_url_filters, op9_token_counts, op10_language_id, op11_lexical_search, op12_filter_audit, op13_byte_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_url_filters": op8_sql(), "op11_lexical_search": OP11_SQL, "op12_filter_audit": OP12_SQL}
