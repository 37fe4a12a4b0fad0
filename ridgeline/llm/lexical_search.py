"""Ranked lexical search: an inverted index in shards, searched document at a time.

Method: each task cuts its documents into shards of a bounded size of text. A shard's postings are sorted by
term and document, and stored compressed: for each term the gaps between its documents and its frequencies as
variable-length integers. The shards' documents are numbered by doc_id, so that every list is sorted by it.
A search reads the lists of its queries' terms, weighs terms by their frequency over all shards, and goes in each shard, for each
query, document by document: a heap merges the lists' cursors, a bounded heap keeps the best documents by score and then doc_id.
Lists whose best scores together can't lift a document above the worst one kept are not merged but looked up (the result is the same).
The shards' best are ranked by query.

A term is a maximal match of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z in lower case; terms are told apart by 64-bit hashes.

Defined results: null texts, empty ones and ones without a term are no documents; queries without a term, or of which no document
has a term, have no rows. Very long texts are indexed whole (one can be larger than a shard). Rows that share an id are documents
of their own each; rows without an id rank after all others of the same score. Of equal scores the smaller id comes first. Rows of
the queries that share an id are one query. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, small_batches

#: A shard ends when its documents have so many bytes of text.
SHARD_BYTES = 24 << 20
#: Queries are searched in blocks of at most so many queries and terms; a block goes through the driver and is broadcast.
BLOCK_QUERIES, BLOCK_TERMS = 20_000, 1_000_000
#: Rows of the index that leave a task at once.
_ROWS = 20_000
_NO_ID = np.iinfo(np.int64).max

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_FOLD[65:91] = np.arange(97, 123)

#: shard, term (null: the shard's own row), n (documents; of a term: those that hold it), total (terms with repeats; of a term: null), data.
INDEX = "shard long, term long, n long, total long, data binary"


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of the terms of whole texts, in pieces: hashes, each text's bounds among them, and the first text's row."""
    data, offsets = textkit.buffers(column)
    for lo, hi in textkit.pieces(column):
        w = textkit.split(_FOLD[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], lo)
        yield w.hashes().view(np.int64), w.first, lo


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as variable-length bytes (seven bits each, the last below 128), and where each one ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, at = np.arange(len(values)), ends - size
    while len(left):
        last = size[left] == 1
        out[at[left]] = (values[left] & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8)
        left = left[~last]
        values[left] >>= np.uint64(7)
        size[left] -= 1
        at[left] += 1
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    """The integers of pack()."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((raw & 127).astype(np.uint64) << shift, starts).astype(np.int64)


class _Shard:
    """The documents of one shard while it is filled."""

    def __init__(self):
        self.ids, self.lens, self.parts, self.bytes = [], [], [], 0

    def add(self, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, n_bytes: int) -> None:
        lens = np.diff(first)
        some = np.flatnonzero(lens)
        if len(hashes):
            base = sum(map(len, self.ids))
            of = np.repeat(np.arange(len(some)), lens[some])
            order = np.lexsort((of, hashes))
            h, of = hashes[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
            self.parts.append((h[begin], (of[begin] + base).astype(np.int32), np.diff(np.append(begin, len(h))).astype(np.int32)))
            self.ids.append(ids[some])
            self.lens.append(lens[some])
        self.bytes += n_bytes

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's own row, and one of each term."""
        if not self.parts:
            return
        ids, lens = np.concatenate(self.ids), np.concatenate(self.lens)
        order = np.argsort(ids, kind="stable")
        ids, lens = ids[order], lens[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        doc = place[doc]
        order = np.lexsort((doc, h))
        h, doc, tf = h[order], doc[order], tf[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        gaps = np.diff(doc, prepend=0)
        gaps[begin] = doc[begin]
        data, ends = pack(np.stack([gaps, tf], axis=1).ravel())
        ends = np.concatenate([[0], ends])[2 * np.append(begin, len(h))]
        own = pack(lens)[0].tobytes()
        head = [np.array([len(ids)]).tobytes(), ids.astype("<i8").tobytes(), own]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.int64()), pa.array([len(ids)]), pa.array([int(lens.sum())]), pa.array([b"".join(head)], pa.binary())], names=["shard", "term", "n", "total", "data"])
        for lo in range(0, len(begin), _ROWS):
            hi = min(lo + _ROWS, len(begin))
            bounds = ends[lo : hi + 1]
            lists = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bounds - bounds[0]).astype(np.int32)), pa.py_buffer(data[bounds[0] : bounds[-1]])])
            df = np.diff(np.append(begin, len(h))[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, shard)), pa.array(h[begin[lo:hi]]), pa.array(df), pa.nulls(hi - lo, pa.int64()), lists], names=["shard", "term", "n", "total", "data"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, as a table of INDEX, written; no shuffle. Ids are integers."""
    small_batches(docs.sparkSession)
    frame = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            ids, text = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False), textkit.utf8(batch.column(1))
            offsets = textkit.buffers(text)[1]
            for hashes, first, row in terms(text):
                n = len(first) - 1
                open_shard.add(ids[row : row + n], hashes, first, int(offsets[row + n] - offsets[row]))
                if open_shard.bytes >= shard_bytes:
                    yield from open_shard.rows((task << 32) + made)
                    made, open_shard = made + 1, _Shard()
        yield from open_shard.rows((task << 32) + made)

    return cut(frame.mapInArrow(run, INDEX))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: each query's terms once."""
    small_batches(queries.sparkSession)
    frame = queries.select(queries[id_col].alias("item"), queries[text_col].alias("text"))
    kind = frame.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, first, row in terms(textkit.utf8(batch.column(1))):
                own = np.unique(np.stack([np.repeat(np.arange(len(first) - 1), np.diff(first)), hashes]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + own[0])), pa.array(own[1])], names=["item", "term"])

    return frame.mapInArrow(run, f"item {kind}, term long").distinct()


def blocks(found: DataFrame, most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> Iterator[dict]:
    """Queries by blocks of bounded size (or one query): item -> its terms. found: as from query_terms()."""
    block, n = {}, 0
    for row in found.orderBy("item", "term").toLocalIterator():
        if row[0] not in block and block and (len(block) >= most_queries or n >= most_terms):
            yield block
            block, n = {}, 0
        block.setdefault(row[0], []).append(row[1])
        n += 1
    if block:
        yield block


def scores(weight: int, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to the score of each of its documents."""
    if int(n.max(initial=0)) * documents * 90 < 1 << 63:
        m = 10 + (90 * n * documents) // length
    else:  # beyond 64 bits in between only
        m = np.array([10 + (90 * int(x) * documents) // length for x in n], np.int64)
    return weight * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m))


class _List:
    """A term's list in a shard: documents in order and what the term adds to each."""

    __slots__ = ("docs", "adds", "best")

    def __init__(self, data: bytes, weight: int, lens: np.ndarray, documents: int, length: int):
        flat = unpack(data)
        docs = np.cumsum(flat[0::2])
        adds = scores(weight, flat[1::2], lens[docs], documents, length)
        self.docs, self.adds, self.best = docs.tolist(), adds.tolist(), int(adds.max(initial=0))


def best_documents(lists: list[_List], k: int) -> list[tuple[int, int]]:
    """The k documents of highest score above 0, as (score, document), by a merge of the lists, document at a time."""
    lists = sorted((x for x in lists if x.best > 0), key=lambda x: x.best)
    bounds = [0]  # the most that the first i lists can add
    for x in lists:
        bounds.append(bounds[-1] + x.best)
    # lists below `least` can't lift a document above the worst of the result, and are looked up only; cursors are one per list
    least, worst, result = 0, 0, []
    heap = [(x.docs[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while heap:
        doc, i = heap[0]
        score = 0
        while True:
            if i < least:  # looked up from now on
                heapq.heappop(heap)
            else:
                own, place = lists[i], at[i]
                score += own.adds[place]
                at[i] = place = place + 1
                if place < len(own.docs):
                    heapq.heapreplace(heap, (own.docs[place], i))
                else:
                    heapq.heappop(heap)
            if not heap or heap[0][0] != doc:
                break
            i = heap[0][1]
        if not score or score + bounds[least] <= worst:
            continue
        for i in range(least - 1, -1, -1):
            own = lists[i]
            at[i] = place = bisect_left(own.docs, doc, at[i])
            if place < len(own.docs) and own.docs[place] == doc:
                score += own.adds[place]
            if score + bounds[i] <= worst:
                break
        if score <= worst:  # of equal scores the document before stays
            continue
        if len(result) < k:
            heapq.heappush(result, (score, -doc))
        else:
            heapq.heapreplace(result, (score, -doc))
        if len(result) == k and result[0][0] > worst:
            worst = result[0][0]
            while least < len(lists) and bounds[least + 1] <= worst:
                least += 1
    return [(s, -d) for s, d in result]


def _search_block(index: DataFrame, block: dict, k: int, totals: tuple[int, int]) -> DataFrame:
    """item, doc, score: the best k documents of each shard for each query of the block."""
    spark = index.sparkSession
    documents, length = totals
    asked = spark.createDataFrame([(t,) for t in sorted(set().union(*block.values()))], "term long")
    # at most BLOCK_TERMS terms (or one query's)
    df = index.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df}
    weights = spark.createDataFrame(sorted((t, w) for t, w in weight.items() if w > 0), "term long, weight long")
    shared = spark.sparkContext.broadcast([(item, [t for t in own if weight.get(t, 0) > 0]) for item, own in block.items()])
    lists = index.where("term IS NOT NULL").join(F.broadcast(weights), "term").select("shard", "term", "weight", "data")
    heads = index.where("term IS NULL").select("shard", "term", F.lit(None).cast("long").alias("weight"), "data")

    def run(table: pa.Table) -> pa.Table:
        term, weight, data = table["term"].to_pylist(), table["weight"].to_pylist(), table["data"].to_pylist()
        head = data[term.index(None)]
        n = int(np.frombuffer(head, "<i8", 1)[0])
        ids, lens = np.frombuffer(head, "<i8", n, 8), unpack(head[8 + 8 * n :])
        own = {t: _List(d, w, lens, documents, length) for t, w, d in zip(term, weight, data, strict=True) if t is not None}
        out = []
        for q, (_, wanted) in enumerate(shared.value):
            out += [(q, s, int(ids[d])) for s, d in best_documents([own[t] for t in wanted if t in own], k)]
        q, s, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int32()), "score": pa.array(s, pa.int64()), "doc": pa.array([None if x == _NO_ID else x for x in d], pa.int64())})

    found = lists.unionByName(heads).groupBy("shard").applyInArrow(run, "query int, score long, doc long")
    return found


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k highest-scoring documents. index: as from build()."""
    spark = index.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    documents, length = (int(x or 0) for x in index.where("term IS NULL").agg(F.sum("n"), F.sum("total")).first())
    found = query_terms(queries, id_col, text_col)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not documents:
        return out
    several = []
    for block in blocks(cut(found), most_queries, most_terms):
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        best = _search_block(index, block, k, (documents, length)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block)), f"query int, item_id {kind}")
        several.append(best.join(F.broadcast(names), "query").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    if len(several) > 1:  # one after the other, so that a plan holds one block
        several = [cut(x) for x in several]
    for x in several:
        out = out.unionByName(x) if len(several) > 1 else x
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents and search them."""
    return search(build(docs), queries, k)
