"""Substring deduplication by Relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks at content-defined anchors,
so equal passages are cut alike wherever they stand. An anchor is the least hash
among the 8-word sequences of a window of `min_words` (35) words; a block holds all
windows whose anchor it is, at most 28. Steps:

1. Each document lists its blocks: anchor, hash of all its words, place. Only an
   anchor that occurs twice in the corpus can lie in a repeated window; the blocks of
   the others are left out.
2. The index has one entry for each distinct block: how often it stands in the
   corpus, and its first and last place, which are its reference positions.
3. Copies end inside blocks that aren't repeated as a whole. There, at the factors'
   boundaries, the windows are looked up one by one among the windows of all indexed
   blocks with the same anchor; a window that is found has its first and last place
   there as reference positions, like a block.
4. A document is parsed from left to right, greedily: a factor begins with all
   reference positions of its first block or boundary window and goes on as long as
   one of them is followed there by what follows here, so it is the longest along any
   of them and reaches from the copy's first word to its last; then the next one
   begins. A factor is (begin, end, reference, reference's begin).
5. Factors of `min_words` words and more are the duplicate spans; their union, and
   nothing else, is removed.

The outcome is exact for the windows (equality by hashes of 128 bits together: the
anchor's and the block's or window's), whichever block or document a repeat lies in.

Scale: the texts are hashed twice and shuffled twice (once to the blocks whose
windows are looked up, once to the result). Besides, 12 to 24 bytes for each block (about
a thirteenth of the words), and the windows of blocks at boundaries, once per distinct
block. Counts are pre-aggregated in each task and written before they are joined, so
that Spark can split the rows of a frequent anchor, block or window over tasks; what a task
holds of one key is what belongs to one document.

Defined results: a null or empty text has no words and is left as it is. Repeated
rows are occurrences of each other. Rows are told apart by id and text (where ids
repeat or are null, by 128 bits of hashes of both), so ids may be null or occur twice.
Of references that reach equally far, the least key and place is the factor's. Very
long texts are parsed whole. Input columns are kept; the operator's own columns replace columns of the same
name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, drop, small_batches
from ridgeline.llm.sentencepiece_codec import _spread

MIN_WORDS, ANCHOR_WORDS = 35, 8
_KEY = ["__k1", "__k2"]
#: A block's place in its document: first window * 64 + number of windows.
_PLACE = 64
#: Anchors are compared by this many upper bits of their hashes, equal ones by place: a window's anchor depends on its words only.
_COMPARED = 32


def anchors(w: textkit.Words, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """The anchors of some texts: hash, text, first window (word number) and number of windows; sorted by place."""
    reach = min_words - ANCHOR_WORDS + 1  # anchor candidates in a window
    g = textkit.grams(hashes, ANCHOR_WORDS)
    if len(hashes) < min_words:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    bits = np.uint64(64 - _COMPARED)
    low = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)  # ties: the leftmost
    step = 1
    while step * 2 <= reach:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if reach > step:
        low = np.minimum(low[: len(low) - (reach - step)], low[reach - step :])
    start = np.flatnonzero(textkit.valid_windows(w.first, min_words, len(hashes) - min_words + 1))
    at = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    first = start[head]
    count = np.diff(np.append(head, len(at)))
    text = textkit.owner(w.first, len(hashes))[first]
    return g[at[head]], text, first, count


def _numbers(lists: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists lo..hi (null: empty) and the index of their list, from lo."""
    part = lists.slice(lo, hi - lo)
    lens = np.array([0 if n is None else n for n in part.value_lengths().to_pylist()], np.int64)
    values = part.flatten()  # a list's values, unlike its field, mind the slice's offset
    return values, np.repeat(np.arange(hi - lo), lens)


def _columns(values: pa.StructArray) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in values.flatten()]


def parse(parts: Iterator[tuple[int, ...]], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """The factors of one text: begin, end, reference, begin in the reference.

    parts: of each repeated block or boundary window, from left to right, its first
    window and number of windows, and two reference positions (key, first window), of
    which the second is another one where the first is the part's own place.
    """
    factors: list[tuple[int, int, int, int]] = []
    begin, after, copies = 0, -1, set()  # the factor's first window, the one after its last; references with their places less ours

    def close() -> None:
        end = after - 1 + min_words
        if copies and end - begin >= min_words:
            ref, shift = min(copies)
            factors.append((begin, end, ref, begin + shift))

    for start, count, k0, s0, k1, s1 in parts:
        here = {(k0, s0 - start), (k1, s1 - start)}
        longer = copies & here if start == after else None
        if not longer:
            close()
            begin = start
        copies, after = longer or here, start + count
    close()
    return factors


def _parsed(docs: DataFrame, id_col: str, text_col: str, min_words: int, keep: list[str], rest_whole: bool) -> DataFrame:
    """keep, n_words, n_removed, spans, factors and kept_text. rest_whole: texts without a repeated passage stay byte for byte."""
    if not ANCHOR_WORDS <= min_words <= ANCHOR_WORDS + 55:
        raise ValueError("min_words is out of range")
    small_batches(docs.sparkSession)
    fields = {c: docs.schema[c] for c in keep}
    key = F.coalesce(F.xxhash64(docs[id_col]) if docs.schema[id_col].dataType != T.LongType() else docs[id_col], F.lit(0))
    # where ids tell rows apart, the text's hash need not travel along; elsewhere two hashes of id and text, 128 bits together, do it
    unique = docs.select(key.alias("k")).groupBy("k").count().where("count > 1").isEmpty()
    key = [key, F.lit(0).cast("long")] if unique else [F.xxhash64(docs[id_col], docs[text_col]), F.xxhash64(docs[text_col], docs[id_col])]
    rows = docs.select(*[k.alias(n) for k, n in zip(key, _KEY, strict=True)], docs[text_col].alias("__text"), *[docs[c].alias(f"__c{i}") for i, c in enumerate(keep)])
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textkit.words(textkit.utf8(batch.column(2))):
                hashes = w.hashes()
                a, text, first, count = anchors(w, hashes, min_words)
                block = textkit.span_hash(hashes, first, first + count - 1 + min_words) if len(a) else a
                of = pa.array(text + w.row)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array((first - w.first[text]) * _PLACE + count)], names=["a", "block", *_KEY, "place"])

    found = rows.select(*_KEY, "__text").mapInArrow(list_blocks, T.StructType(longs("a", "block", *_KEY, "place")))
    twice = cut(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    hits = cut(found.join(twice, "a"))
    drop(twice)
    place = F.struct(*_KEY, "place")
    index = cut(hits.groupBy("a", "block").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")))
    copied = hits.join(index.where("n > 1").select("a", "block", "first", "last"), ["a", "block"])

    def part(place: Column, count: Column, window: Callable[[Column], Column]) -> Column:
        """A part of the parse; its references are other places than its own, if there are any."""
        first, last = F.col("first"), F.col("last")
        refs = [F.when(place == first, last).otherwise(first), F.when(place == last, first).otherwise(last)]
        return F.struct(window(place).alias("start"), count.alias("count"), *(x for i, r in enumerate(refs) for x in (r["__k1"].alias(f"k{i}"), window(r).alias(f"s{i}"))))

    block = part(place, F.pmod("place", F.lit(_PLACE)), lambda p: F.floor(p["place"] / _PLACE))
    # boundaries: anchors with several distinct blocks, of which one stands alone
    mixed = cut(index.groupBy("a").agg(F.count("*").alias("blocks"), F.min("n").alias("least")).where("blocks > 1 AND least = 1").select("a"))
    asked = index.join(mixed, "a").select("first.*", "a", (F.col("n") == 1).alias("alone"))
    asked = cut(asked.groupBy(*_KEY).agg(F.collect_list(F.struct("place", "a", "alone")).alias("__asked")))
    drop(mixed)

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for w in textkit.words(textkit.utf8(batch.column(2))):
                values, of = _numbers(lists, w.row, w.row + len(w))
                if not len(of):
                    continue
                places, a, alone = _columns(values)
                windows, count = textkit.grams(w.hashes(), min_words), places % _PLACE
                at = _spread(w.first[of] + places // _PLACE, count)
                of, a, alone = (np.repeat(x, count) for x in (of, a, alone))
                rows = pa.array(of + w.row)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(windows[at].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - w.first[of]), pa.array(alone)], names=["a", "h", *_KEY, "at", "alone"])

    windows = rows.select(*_KEY, "__text").join(asked, _KEY).mapInArrow(list_windows, T.StructType([*longs("a", "h", *_KEY, "at"), T.StructField("alone", T.BooleanType())]))
    windows = cut(windows)
    drop(asked)
    again = cut(windows.groupBy("a", "h").agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n"), F.bool_or("alone").alias("alone")).where("n > 1 AND alone").select("a", "h"))
    shared = cut(windows.join(again, ["a", "h"]))
    drop(windows, again)
    at = F.struct(*_KEY, "at")
    places = cut(shared.groupBy("a", "h").agg(F.min(at).alias("first"), F.max(at).alias("last")))
    checked = shared.where("alone").join(places, ["a", "h"])
    window = part(at, F.lit(1).cast("long"), lambda p: p["at"])
    parts = copied.select(*_KEY, block.alias("p")).union(checked.select(*_KEY, window.alias("p")))
    matches = cut(parts.groupBy(*_KEY).agg(F.collect_set("p").alias("__parts")))
    drop(hits, index, shared, places)
    schema = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in fields.items()] + longs("n_words", "n_removed") + [T.StructField("spans", T.ArrayType(T.StructType(longs("begin", "end")))), T.StructField("factors", T.ArrayType(T.StructType(longs("begin", "end", "ref", "ref_begin")))), T.StructField("kept_text", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = textkit.utf8(batch.column(2))
            for w in textkit.words(texts):
                n = len(w.starts)
                steps = np.zeros(n + 1, np.int64)
                values, of = _numbers(lists, w.row, w.row + len(w))
                factors, n_factors = [], np.zeros(len(w), np.int64)
                if len(of):
                    columns = _columns(values)
                    order = np.lexsort((columns[0], of))
                    columns, bounds = [c[order].tolist() for c in columns], np.searchsorted(of[order], np.arange(len(w) + 1))
                    for i in np.flatnonzero(np.diff(bounds)).tolist():
                        own = parse(zip(*(c[bounds[i] : bounds[i + 1]] for c in columns), strict=True), min_words)
                        n_factors[i] = len(own)
                        factors += own
                factors = np.array(factors, np.int64).reshape(-1, 4)
                base = np.repeat(w.first[:-1], n_factors)
                np.add.at(steps, base + factors[:, 0], 1)
                np.add.at(steps, base + factors[:, 1], -1)
                gone = np.cumsum(steps)[:n] > 0
                owner = textkit.owner(w.first, n)
                begin, end = textkit_spans(gone, owner)
                base = w.first[owner[begin]] if len(begin) else begin
                spans = _lists(np.searchsorted(begin, w.first), ("begin", "end"), (begin - base, end - base))
                factors = _lists(np.concatenate([[0], np.cumsum(n_factors)]), ("begin", "end", "ref", "ref_begin"), factors.T)
                text, per_text = _kept_text(w, gone)
                removed = np.diff(w.first) - per_text
                if rest_whole:
                    text = pc.if_else(pa.array(removed > 0), text, batch.column(2).slice(w.row, len(w)).cast(pa.string()))  # null stays null
                yield pa.RecordBatch.from_arrays([batch.column(3 + i).slice(w.row, len(w)) for i in range(len(keep))] + [pa.array(np.diff(w.first)), pa.array(removed), spans, factors, text], names=schema.names)

    return rows.join(matches, _KEY, "left").mapInArrow(remove, schema)


def _lists(bounds: np.ndarray, names: tuple[str, ...], columns) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list(names)))


def _kept_text(w: textkit.Words, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words left of each text, joined by one space, and their number."""
    # each followed by a space, less the last space of each text
    stay = np.flatnonzero(~gone)
    size = w.ends[stay] - w.starts[stay] + 1
    flat = np.append(w.data, np.uint8(32))[_spread(w.starts[stay], size)]
    after = np.cumsum(size)
    flat[after - 1] = 32
    stay_first = np.searchsorted(stay, w.first)
    per_text = np.diff(stay_first)
    last = after[stay_first[1:][per_text > 0] - 1] - 1
    flat = np.delete(flat, last)
    offsets = np.concatenate([[0], after])[stay_first] - np.concatenate([[0], np.cumsum(per_text > 0)])
    return pa.StringArray.from_buffers(len(w), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))), per_text


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_removed, spans (word numbers, end exclusive), factors and kept_text (the words left, joined by one space).

    factors: begin, end, ref (the reference's id where ids are unique numbers, else a hash) and begin there.
    """
    own = ("n_words", "n_removed", "spans", "factors", "kept_text")
    return _parsed(docs, id_col, text_col, min_words, [c for c in (docs.columns if keep is None else keep) if c not in own], False)


def textkit_spans(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of set flags; a run ends with its text."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.flatnonzero(flags & (cut | ~np.concatenate([[False], flags[:-1]])))
    end = np.flatnonzero(flags & np.concatenate([cut[1:] | ~flags[1:], [True]])) + 1
    return begin, end


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated passages; texts without any stay byte for byte."""
    names = [f"__d{i}" for i in range(len(docs.columns))]
    text, others = names[docs.columns.index(text_col)], [n for n, c in zip(names, docs.columns, strict=True) if c != text_col]
    found = _parsed(docs.toDF(*names), names[docs.columns.index(id_col)], text, min_words, others, True)
    return found.select(*(F.col("kept_text" if n == text else n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
