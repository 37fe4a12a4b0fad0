"""Benchmark decontamination by spaced-seed hashing.

Method: words (bytes other than white space, A-Z as a-z) of benchmark items and
documents are hashed under fixed masks that ignore some positions, so that a
substituted word spoils only the seeds that look at it. Document hashes are looked
up among the benchmark's, and each hit's diagonal is verified: a run scores +1 for
an equal word and -MISMATCH for another, and each maximal run (the best one, then
the best ones before and after it, and so on) counts as a leak when at least
`min_words` words agree (for a shorter item 80 % of its words). Any
verbatim overlap of `min_words` words is found, because every mask spans fewer.
Items shorter than a mask are looked up whole.

The benchmark is used in blocks of at most `block_items` items and BLOCK_WORDS words (or
one longer item) whose index is built by the driver and broadcast: its size is bounded by
the parameters; more items mean more passes over the documents, each of which is
written and its broadcast released before the next block is read.

Defined results: null or empty texts and items match nothing; repeated items and
documents each get their own rows, also under null ids. Ids may have any type. Very long
texts are scanned whole; where many items share a seed, their hits are expanded in
pieces of bounded size. Other columns are ignored; a document id column that is called
like a column of the result gets `document_` before its name. An empty benchmark or no
documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, small_batches
from ridgeline.llm.sentencepiece_codec import _spread

#: Fixed masks: 1 looks at the word, 0 ignores it. Each spans at most MIN_WORDS words.
MASKS = ("11111111", "1101100101011", "110010111011", "1110010110111")
MIN_WORDS, MISMATCH, BLOCK_ITEMS, BLOCK_WORDS = 13, 3, 20_000, 2_000_000
COLUMNS = ("doc_begin", "doc_end", "item_begin", "item_end", "n_matched")
_FILTER_BITS, _MOST_HITS = 22, 1 << 20


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under the mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) * 131 + int(mask, 2) % 127, np.uint64)
    for at, look in enumerate(mask):
        if look == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[at : at + n]
    return textkit.mix(out)


def runs(scores: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The maximal runs of positive score, the best first; stretches of fewer than `least` words are not searched."""
    open_parts = [(0, len(scores))]
    while open_parts:
        lo, hi = open_parts.pop()
        if hi - lo < least:
            continue
        sums = np.concatenate([[0], np.cumsum(scores[lo:hi])])
        end = int((sums - np.minimum.accumulate(sums)).argmax())
        begin = int(sums[: end + 1].argmin())
        if end <= begin:
            continue
        yield lo + begin, lo + end
        open_parts += [(lo + end, hi), (lo, lo + begin)]


class Index:
    """Seeds of some benchmark items, sorted, with the places that they stand for."""

    def __init__(self, ids: list, texts: list[str | None], masks: tuple[str, ...] = MASKS):
        column = textkit.utf8(pa.array(texts, pa.string()))
        parts = [(w.hashes(lower=True), np.diff(w.first)) for w in textkit.words(column)]
        self.hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        lens = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.ids = ids
        shortest = min(map(len, masks))
        short = sorted({int(n) for n in lens if 0 < n < shortest})
        self.masks = [*masks, *("1" * n for n in short)]
        of = textkit.owner(self.first, len(self.hashes))
        seeds, places, which = [], [], []
        for m, mask in enumerate(self.masks):
            h = masked(self.hashes, mask)
            at = np.flatnonzero(textkit.valid_windows(self.first, len(mask), len(h))) if len(h) else np.zeros(0, int)
            if m >= len(masks):
                at = at[lens[of[at]] == len(mask)]
            seeds.append(h[at])
            places.append(at)
            which.append(np.full(len(at), m))
        self.seeds, self.places = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.places = self.seeds[order], self.places[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.of = of

    def hits(self, w: textkit.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, diagonal): diagonal = word of the text less word of the item."""
        texts, items, diagonals = [], [], []
        of = textkit.owner(w.first, len(hashes))
        low = np.uint64((1 << _FILTER_BITS) - 1)
        for mask in self.masks:
            h = masked(hashes, mask)
            at = np.flatnonzero(self.filter[h & low])
            at = at[at + len(mask) <= w.first[of[at] + 1]]
            lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(n):
                continue
            cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), _MOST_HITS))
            for a, b in zip(cuts, np.append(cuts[1:], len(n)), strict=True):
                own, place = np.repeat(at[a:b], n[a:b]), self.places[_spread(lo[a:b], n[a:b])]
                item = self.of[place]
                found = np.unique(np.stack([of[own], item, own - w.first[of[own]] - place + self.first[item]]), axis=1)
                texts.append(found[0])
                items.append(found[1])
                diagonals.append(found[2])
        if not texts:
            return (np.zeros(0, np.int64),) * 3
        found = np.unique(np.stack([np.concatenate(texts), np.concatenate(items), np.concatenate(diagonals)]), axis=1)
        return found[0], found[1], found[2]

    def leaks(self, w: textkit.Words, min_words: int = MIN_WORDS) -> list[tuple[int, ...]]:
        """(text, item's number, word bounds in the text, word bounds in the item, equal words) of each verified overlap."""
        hashes = w.hashes(lower=True)
        out = []
        if not len(hashes) or not len(self.seeds):
            return out
        for text, item, diagonal in zip(*(x.tolist() for x in self.hits(w, hashes)), strict=True):
            own, of_item = hashes[w.first[text] : w.first[text + 1]], self.hashes[self.first[item] : self.first[item + 1]]
            lo, hi = max(0, -diagonal), min(len(of_item), len(own) - diagonal)
            equal = own[lo + diagonal : hi + diagonal] == of_item[lo:hi]
            least = min_words if len(of_item) >= min_words else -(-len(of_item) * 8 // 10)
            for begin, end in runs(np.where(equal, 1, -MISMATCH), max(least, 1)):
                n = int(equal[begin:end].sum())
                if n >= max(least, 1):
                    out.append((text, item, lo + diagonal + begin, lo + diagonal + end, lo + begin, lo + end, n))
        return out


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, block_items: int) -> Iterator[Index]:
    """Indexes of the benchmark's blocks; at least one."""
    small_batches(benchmark.sparkSession)
    ids, texts, n_words, made = [], [], 0, 0
    for row in benchmark.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        if not row[1]:
            continue
        ids.append(row[0])
        texts.append(row[1])
        n_words += len(row[1].split())
        if len(ids) >= block_items or n_words >= BLOCK_WORDS:
            yield Index(ids, texts)
            ids, texts, n_words, made = [], [], 0, made + 1
    if ids or not made:
        yield Index(ids, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document, item and place where a sufficiently long overlap lies; no shuffle of documents."""
    name = f"document_{id_col}" if id_col in ("item_id", *COLUMNS) else id_col
    schema = T.StructType([T.StructField(name, docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_id_col].dataType), *(T.StructField(c, T.LongType()) for c in COLUMNS)])
    frame = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    item_type = to_arrow_type(schema["item_id"].dataType)

    def scan(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            items = pa.array(own.ids, item_type)
            for batch in batches:
                for w in textkit.words(textkit.utf8(batch.column(1))):
                    if found := own.leaks(w, min_words):
                        text, item, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([w.row + t for t in text])), items.take(pa.array(item)), *(pa.array(x, pa.int64()) for x in rest)], names=schema.names)

        return frame.mapInArrow(run, schema)

    out = before = None
    for index in _blocks(benchmark, item_id_col, item_text_col, block_items):
        if before is not None:  # several blocks: one after the other
            out = cut(out)
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(index)
        out = scan(before) if out is None else out.unionByName(scan(before))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents without a leak, row by row, whatever their ids; where the benchmark takes several passes, the rows left are written between them."""
    at = docs.columns.index(text_col)
    left, before = docs, None
    for index in _blocks(benchmark, item_id_col, item_text_col, block_items):
        if before is not None:
            left = cut(left)
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], index=before) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for w in textkit.words(textkit.utf8(batch.column(at))):
                    stays[[w.row + f[0] for f in index.value.leaks(w, min_words)]] = False
                yield batch.filter(pa.array(stays))

        left = left.mapInArrow(run, docs.schema)
    return left
