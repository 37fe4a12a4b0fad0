"""Quality classification by hierarchical empirical Bayes.

Method: three sources of evidence on whether a document is bad (low quality or
toxic) are combined.

- The document: a logistic regression on hashed words and shares of characters,
  fitted on a bounded sample of labelled rows.
- Its host: the posterior mean of the host's rate of bad labels under a Beta prior
  around the global rate, whose strength is estimated from all hosts by the method
  of moments: the less hosts differ, the more a host shrinks.
- Its path within the host: the same one level below, shrinking to the host.

Labels are counted by one grouped aggregation over host and path; sites without a
label take the next level's rate. A document's log odds are the classifier's plus
the difference of the site's log odds from the global ones.

The training sample is bounded by `most_rows` labelled rows and `max_doc_bytes`
each, taken in the order of a hash of the id, one text of each id (the least); counts of
labels cover all rows.

Defined results: a null or empty text has no document evidence but its shares of
characters; a null host or path counts as the empty one. Without any labels every
row is kept at probability 0.5. Rows that share an id share its labels (the worst
of several), and each counts for its site; repeated rows get the same result each. At a
tie with the threshold a row is not kept. Very long texts are scored whole. Input columns
are kept; own columns replace columns of the same name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, few, small_batches

MOST_ROWS, MAX_DOC_BYTES = 8_000, 30_000
BUCKETS_LOG2, EPOCHS, RATE, PENALTY = 20, 12, 0.3, 1e-5
#: A word bucket is used if its rate among bad rows differs from that among others by so many standard errors.
LEAST_Z, LEAST_ROWS = 4.0, 4
#: Strength limits of the Beta priors, in labels.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000.0
_SHAPES = 5
_BARE = np.arange(256, dtype=np.uint8)
_BARE[[b for b in range(128) if not chr(b).isalnum()]] = 32  # ASCII marks part words here


def features(w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct word buckets (flat, with bounds) and its shares of characters."""
    bare = textkit.split(_BARE[w.data], w.offsets)
    h = (bare.hashes(lower=True) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    of = textkit.owner(bare.first, len(h))
    pairs = np.unique(of << BUCKETS_LOG2 | h)
    bounds = np.searchsorted(pairs >> BUCKETS_LOG2, np.arange(len(w) + 1))
    data = w.data
    size = np.maximum(np.diff(w.offsets), 1)
    share = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[w.offsets]) / size
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    n_words = np.diff(w.first)
    unique = np.diff(bounds) / np.maximum(n_words, 1)
    shapes = np.stack([share(symbol) * 10, share(upper) * 3, share(digit) * 5, 1 - unique, 1 / (1 + n_words)], axis=1)
    return pairs & ((1 << BUCKETS_LOG2) - 1), bounds, shapes


def fit(texts: list[bytes], bad: list[bool]) -> np.ndarray:
    """Weights: word buckets, shares, bias. AdaGrad over mini-batches in a fixed order."""
    column = textkit.utf8(pa.array([t.decode() for t in texts], pa.string()))
    parts = [features(w) for w in textkit.words(column)]
    words = np.concatenate([p[0] for p in parts])
    lens = np.concatenate([np.diff(p[1]) for p in parts])
    bounds = np.concatenate([[0], np.cumsum(lens)])
    shapes = np.concatenate([p[2] for p in parts])
    y = np.array(bad, float)
    n_words = 1 << BUCKETS_LOG2
    of_all = np.repeat(np.arange(len(y)), lens)
    rows_with = np.bincount(words, minlength=n_words)
    bad_with = np.bincount(words, y[of_all], n_words)
    rate = y.mean()
    spread = np.sqrt(np.maximum(rows_with * rate * (1 - rate), 1e-9))
    used = (np.abs(bad_with - rows_with * rate) >= LEAST_Z * spread) & (rows_with >= LEAST_ROWS)
    sel = used[words]
    words, of_all = words[sel], of_all[sel]
    lens = np.bincount(of_all, minlength=len(y))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    weights, gains = np.zeros(n_words + _SHAPES + 1), np.full(n_words + _SHAPES + 1, 1e-3)
    weights[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    order, size = np.random.default_rng(7), 64
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for at in range(0, len(y), size):
            rows = shuffled[at : at + size]
            flat = words[np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])]
            of = np.repeat(np.arange(len(rows)), lens[rows])
            z = np.bincount(of, weights[flat], len(rows)) + shapes[rows] @ weights[n_words:-1] + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
            own, inverse = np.unique(flat, return_inverse=True)
            grad = np.bincount(inverse, error[of], len(own)) / len(rows) + PENALTY * weights[own]
            gains[own] += grad * grad
            weights[own] -= RATE * grad / np.sqrt(gains[own])
            dense = np.append(error @ shapes[rows], error.sum()) / len(rows)
            gains[n_words:] += dense * dense
            weights[n_words:] -= RATE * dense / np.sqrt(gains[n_words:])
    return weights.astype(np.float32)


def scores(weights: np.ndarray, w: textkit.Words) -> np.ndarray:
    """The classifier's log odds of bad for each text."""
    words, bounds, shapes = features(w)
    total = np.diff(np.concatenate([[0.0], np.cumsum(weights[words], dtype=float)])[bounds])
    return total + shapes @ weights[1 << BUCKETS_LOG2 : -1] + weights[-1]


def _strength(stats: DataFrame, bad: str, n: str, mean: Column) -> float:
    """The Beta prior's strength by moments: how far the groups' rates spread beyond chance."""
    rate = F.col(bad) / F.col(n)
    r = stats.where(F.col(n) >= 2).select((F.col(n) * (rate - mean) ** 2).alias("d"), (mean * (1 - mean)).alias("v"), F.col(n).alias("n")).agg(F.sum("d"), F.sum("v"), F.sum((F.col("n") - 1) * F.col("v"))).first()
    if not r[0] or not r[2]:
        return MOST_STRENGTH
    excess = (r[0] - r[1]) / r[2]  # the share of variance between groups
    return float(np.clip((1 - excess) / excess, LEAST_STRENGTH, MOST_STRENGTH)) if excess > 0 else MOST_STRENGTH


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """host, host_rate; host, path, path_rate; the global rate. labelled: host, path, bad (0 or 1)."""
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("bads"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bads").alias("host_bads"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_bads")).first()
    rate = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    k = _strength(hosts, "host_bads", "host_n", F.lit(rate))
    hosts = hosts.select("host", ((F.col("host_bads") + k * rate) / (F.col("host_n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = _strength(paths, "bads", "n", F.col("host_rate"))
    paths = paths.select("host", "path", ((F.col("bads") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    return hosts, paths, float(rate)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, bad: Column | None = None, train_on: Column | None = None, keep: list[str] | None = None, threshold: float = 0.5, most_rows: int = MOST_ROWS) -> DataFrame:
    """Add p_document, p_site, p_bad and kept (p_bad below the threshold).

    labels: id_col and what `bad` reads (default: quality 0 or toxic 1). train_on:
    which labelled ids may be learned from (default: all).
    """
    small_batches(docs.sparkSession)
    own = ("p_document", "p_site", "p_bad", "kept")
    kept_cols = [c for c in (docs.columns if keep is None else keep) if c not in own]
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    known = labels.select(F.col(id_col).alias("__id"), F.coalesce(bad, F.lit(None)).cast("int").alias("bad")).where("bad IS NOT NULL AND __id IS NOT NULL")
    if train_on is not None:
        known = known.withColumnRenamed("__id", id_col).where(train_on).withColumnRenamed(id_col, "__id")
    known = cut(known.groupBy("__id").agg(F.max("bad").alias("bad")))
    sites = docs.select(F.col(id_col).alias("__id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    hosts, paths, rate = site_posteriors(sites.join(known, "__id"))
    # written, so that they are broadcast if they are small, else Spark can split a large site's rows over tasks
    hosts, paths = cut(hosts.withColumnRenamed("host", "__host")), cut(paths.withColumnsRenamed({"host": "__host", "path": "__path"}))
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    fits = docs.where((size > 0) & (size <= MAX_DOC_BYTES)).select(F.col(id_col).alias("__id"))
    chosen = [(r[0], r[1]) for r in fits.join(known, "__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most_rows).collect()]  # bounded by the parameter
    weights = None
    if chosen:
        ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("bad", T.IntegerType())]))
        got = docs.where((size > 0) & (size <= MAX_DOC_BYTES)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "__id").groupBy("__id", "bad").agg(F.min("t").alias("t")).collect()  # one text of each id
        got.sort(key=lambda r: (r["__id"], r["t"]))
        weights = fit([r["t"].encode() for r in got], [bool(r["bad"]) for r in got])
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(text_col).alias("__text"), F.coalesce(host.cast("string"), F.lit("")).alias("__host"), F.coalesce(path.cast("string"), F.lit("")).alias("__path"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(kept_cols)))
    schema = T.StructType([T.StructField("__logit", T.DoubleType())] + rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for w in textkit.words(textkit.utf8(batch.column(0))):
                z = np.zeros(len(w)) if weights is None else scores(weights, w)
                yield pa.RecordBatch.from_arrays([pa.array(z)] + [batch.column(i).slice(w.row, len(w)) for i in range(1, batch.num_columns)], names=schema.names)

    out = rows.mapInArrow(run, schema)
    out = out.join(few(hosts), "__host", "left").join(few(paths), ["__host", "__path"], "left")
    logit = lambda p: F.log(p / (1 - p))
    site = F.coalesce("path_rate", "host_rate", F.lit(rate))
    p_bad = 1 / (1 + F.exp(-(F.col("__logit") + logit(site) - logit(F.lit(rate)))))
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept_cols)), (1 / (1 + F.exp(-F.col("__logit")))).alias("p_document"), site.alias("p_site"), p_bad.alias("p_bad")).withColumn("kept", (F.col("p_bad") < threshold) if chosen else F.lit(True))
