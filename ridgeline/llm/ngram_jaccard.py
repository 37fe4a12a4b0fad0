"""N-gram Jaccard join by grouped prefix filtering.

A document's set holds the distinct shingles of `k` words (A-Z as a-z; with fewer
words the whole sequence is one). Two documents link when 100 * |A & B| >=
percent * |A | B|. Steps:

1. Order. All shingles of all documents are counted in 2**`bits` hashed buckets, and
   the shingles are ordered by their bucket's count, then by hash: frequent ones
   last. Any order gives right results; this one keeps posting lists short. The
   table of counts has a fixed size (a byte for each bucket, broadcast).
2. Each document gives its set's size, a 128-bit digest of the set, and its prefix:
   the n - ceil(percent * n / 100) + 1 first shingles in the order.
3. Documents with one prefix and size are one group. Each group is listed under each
   of its prefix's shingles; lists are sorted streams, so none is held in memory. Lists
   of very frequent shingles are split into shards.
4. Short lists (at most SHORT groups): pairs of groups are filtered by size, position
   and a sketch that bounds the sets' difference from below (all exact bounds), then verified on
   the whole sets: first one pair of each document, then those that still lie
   between components, as a pair within one can't change the result.
5. Long lists, and groups of several members: first LEADS members are drawn from each and
   paired with the others (each document with at most LEADS of all that are drawn), then lists whose members are all in one component by now are
   done. In the others all pairs of members from different components are filtered and
   verified the same way. So no link between components is lost.
6. Components by star contraction.

Scale: four passes over the texts, of which the last one reads only documents in
candidate pairs. Shuffled: 24 bytes for each prefix shingle, once. Copies count as
one; a list of near copies costs its length, not its square.

Defined results: null, empty or blank text: empty set, size 0, linked with
nothing. Rows that share an id are one node, with the links of all its texts. A row
with a null id links nothing and has a null component. Very long texts are used
whole. Other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, drop, few, small_batches, stars

SHINGLE_WORDS, PERCENT = 4, 85
#: Buckets of the table of counts (log2), and the count from which a bucket's lists are split into so many shards.
BITS, HOT_COUNT, SHARDS = 22, 4096, 16
#: Of lists of at most so many groups all pairs are tried at once; of longer ones first the pairs with so many drawn members.
SHORT, LEADS = 16, 8
_BINS, _SLICE_BITS, _SHARD_BITS = 512, 16, 4
_LEVEL_AT = np.int64(55)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts: first row, their distinct shingles as sorted 62-bit numbers one after the other, and the bounds."""
    for w in textkit.words(column):
        hashes = w.hashes(lower=True)
        lo, hi = w.first[:-1], w.first[1:]
        n = hi - lo
        g = (textkit.grams(hashes, k) >> np.uint64(2)).view(np.int64)
        own = np.flatnonzero(textkit.valid_windows(w.first, k, len(g))) if len(g) else np.zeros(0, np.int64)
        text, values = textkit.owner(w.first, len(hashes))[own], g[own]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = (textkit.span_hash(hashes, lo[short], hi[short]) >> np.uint64(2)).view(np.int64)
            text, values = np.concatenate([text, short]), np.concatenate([values, whole])
        order = np.lexsort((values, text))
        text, values = text[order], values[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        yield w.row, values[new], np.searchsorted(text[new], np.arange(len(w) + 1))


def prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def shingle_levels(docs: DataFrame, text_col: str, k: int, bits: int) -> np.ndarray:
    """How frequent each bucket of shingles is, over all documents: 8 * log2(1 + count), one byte each.

    Each task counts its own buckets and sends them in compressed slices; each slice is summed as a stream.
    """
    slice_bits = min(bits, _SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, flat, _ in _sets(textkit.utf8(batch.column(0)), k):
                np.add.at(total, flat & np.int64((1 << bits) - 1), 1)
        for i, part in enumerate(total.reshape(-1, 1 << slice_bits)):
            if part.any():
                small = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "width": pa.array([small.itemsize], pa.int32()), "counts": pa.array([pa.compress(small.tobytes(), "zstd", asbytes=True)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, width, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(counts, width << slice_bits, "zstd", asbytes=True), np.uint8 if width == 1 else np.int32)
                sums[i] = sums.get(i, 0) + part.astype(np.int64)
        for i, s in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "levels": pa.array([np.minimum(255, 8 * np.log2(1.0 + s)).astype(np.uint8).tobytes()], pa.binary())})

    slices = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "slice int, width int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for i, levels in slices.repartition(1 << (bits - slice_bits), "slice").mapInArrow(add, "slice int, levels binary").collect():  # 2**bits bytes, whatever the input
        out[i << slice_bits : (i + 1) << slice_bits] = np.frombuffer(levels, np.uint8)
    return out


def _prefixes(flat: np.ndarray, first: np.ndarray, percent: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' prefixes one after the other in the global order, their bounds, and a hash of each with its size."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    value = (levels[flat & np.int64(len(levels) - 1)].astype(np.int64) << _LEVEL_AT) | (flat >> np.int64(7))
    value = value[np.lexsort((value, text))]
    place = np.arange(len(flat)) - first[text]
    size = np.where(n > 0, prefix_length(n, percent), 0)
    chosen = value[place < size[text]]
    bounds = np.concatenate([[0], np.cumsum(size)])
    group = textkit.span_hash(chosen.view(np.uint64), bounds[:-1], bounds[1:])
    return chosen, bounds, textkit.mix(group ^ n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _summaries(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, levels) -> DataFrame:
    """id, n, digest s1 s2, group g and sketch of each document.

    The sketch has the parity of the number of shingles in each of 512 bins. Where
    two sketches differ, the sets differ in at least one shingle of that bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, flat, first in _sets(textkit.utf8(batch.column(1)), k):
                n = np.diff(first)
                u = flat.view(np.uint64)
                s1, s2 = (np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(u ^ np.uint64(c)))]) for c in (0x1234567, 0xABCDEF01234))
                digest = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in (s1, s2)]
                bins = np.repeat(np.arange(len(n)), n) * _BINS + (flat & (_BINS - 1))
                sketch = np.packbits((np.bincount(bins, minlength=len(n) * _BINS) & 1).astype(np.uint8)).view(np.int64)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sketch) + 1, _BINS // 64, dtype=np.int32)), pa.array(sketch))
                group = _prefixes(flat, first, percent, levels.value)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), *map(pa.array, (n, *digest, group)), sketches], names=["id", "n", "s1", "s2", "g", "sketch"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "s1", "s2", "g")), T.StructField("sketch", T.ArrayType(T.LongType(), False))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _postings(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, levels, hot_count: int) -> DataFrame:
    """h (shingle and shard), g, ni (the set's size * 2**32 + the shingle's place) for each group's prefix; at least once for each task that has the group."""
    hot_level = min(255, int(8 * np.log2(1.0 + hot_count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.int64)
            for _, flat, first in _sets(textkit.utf8(batch.column(0)), k):
                chosen, bounds, group = _prefixes(flat, first, percent, levels.value)
                size, n = np.diff(bounds), np.diff(first)
                is_new = np.zeros(len(group), bool)
                is_new[np.unique(group, return_index=True)[1]] = True
                is_new &= (size > 0) & ~np.isin(group, seen)
                seen = np.concatenate([seen, group[is_new]])
                of = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(chosen)) - bounds[of]
                take = is_new[of]
                h, of, place = chosen[take], of[take], place[take]
                shard = np.where((h >> _LEVEL_AT) >= hot_level, group[of] & np.int64(SHARDS - 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(h >> np.int64(_SHARD_BITS) << np.int64(_SHARD_BITS) | shard), pa.array(group[of]), pa.array((n[of] << np.int64(32)) | place)], names=["h", "g", "ni"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("t")).mapInArrow(run, "h long, g long, ni long")


def _possible(na, ia, nb, ib, percent: int):
    """Whether sets of these sizes may link if their first shared shingle has these places; on columns or on arrays."""
    most, fewest, ceil = (F.greatest, F.least, F.ceil) if isinstance(na, Column) else (np.maximum, np.minimum, np.ceil)
    needed = ceil((na + nb) * percent / (100.0 + percent) - 1e-9)
    return (100 * fewest(na, nb) >= percent * most(na, nb)) & (fewest(na - ia, nb - ib) >= needed)


def _scan_lists(postings: DataFrame, percent: int, hot_count: int) -> DataFrame:
    """Of short lists the pairs of groups that may link (g, other); of long and split lists their rows (h, g, ni), other null.

    Sorted streams: what is kept between batches is the last list's rows as long as it may be a short one.
    """
    hot_level = min(255, int(8 * np.log2(1.0 + hot_count)))

    def out(h, g, ni, other=None):
        other = pa.nulls(len(h), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(ni), other], names=["h", "g", "ni", "other"])

    def emit(h, ni, g, run, long):
        """run: the list of each row; long: whether that list is long."""
        if long.any():
            yield out(h[long], g[long], ni[long])
        h, ni, g, run = h[~long], ni[~long], g[~long], run[~long]
        n, i = ni >> np.int64(32), ni & np.int64((1 << 32) - 1)
        first = np.arange(max(0, len(h) - 1))
        for d in range(1, SHORT):
            first = first[first + d < len(h)]
            first = first[run[first] == run[first + d]]  # a list without a pair at this distance has none farther apart
            if not len(first):
                break
            a, b = first, first + d
            ok = _possible(n[a], i[a], n[b], i[b], percent)
            if ok.any():
                a, b = a[ok], b[ok]
                yield out(np.zeros(len(a), np.int64), np.minimum(g[a], g[b]), np.zeros(len(a), np.int64), np.maximum(g[a], g[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]  # h, ni, g of the last list, if it may be a short one
        long_list = last = None  # a long list that may go on; the last row's h and g
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            again = np.zeros(len(rows[0]), bool)  # the group has come from another task already
            again[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[2][1:] == rows[2][:-1])
            again[0] = (rows[0][0], rows[2][0]) == last
            last = (rows[0][-1], rows[2][-1])
            h, ni, g = (np.concatenate([x, y[~again]]) for x, y in zip(held, rows, strict=True))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            of = np.cumsum(new) - 1
            size = np.bincount(of)
            long = ((size > SHORT) | (h[new] == long_list) | ((h[new] >> _LEVEL_AT) >= hot_level))[of]
            wait = (of == of[-1]) & ~long
            yield from emit(h[~wait], ni[~wait], g[~wait], of[~wait], long[~wait])
            held = [x[wait] for x in (h, ni, g)]
            long_list = h[-1] if long[-1] else None
        if len(held[0]):
            yield from emit(*held, np.zeros(len(held[0]), np.int64), np.zeros(len(held[0]), bool))

    dealt = postings.select("h", "ni", "g").repartition("h").sortWithinPartitions("h", "ni", "g")
    return dealt.mapInArrow(run, "h long, g long, ni long, other long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, shingles of the wanted ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, flat, first in _sets(textkit.utf8(batch.column(1)), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(first) - 1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))], names=["id", "shingles"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("shingles", T.ArrayType(T.LongType(), False))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, schema)


def _similar(na: Column, sa: str, nb: Column, sb: str, percent: int) -> Column:
    """Whether the sizes and the sketches sa, sb leave room for a link: a lower bound of the sets' difference."""
    differ = sum((F.bit_count(F.element_at(sa, i).bitwiseXOR(F.element_at(sb, i))) for i in range(2, _BINS // 64 + 1)), F.bit_count(F.element_at(sa, 1).bitwiseXOR(F.element_at(sb, 1))))
    needed = F.ceil((na + nb) * percent / (100.0 + percent) - 1e-9)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= na + nb - 2 * needed)


def _links(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Of the written pairs a, b those whose whole sets link, written."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _whole_sets(docs, few(ids), id_col, text_col, k)
    checked = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    out = cut(checked.where((100 + percent) * shared >= percent * (F.size("xa") + F.size("xb"))).select("a", "b"))
    drop(ids)
    return out


def _connect(pairs: DataFrame, links: DataFrame | None, verify) -> DataFrame:
    """The links, and those of the written pairs a, b (a < b) that connect components.

    First one pair of each id is verified, then what still lies between components.
    """
    one = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = verify(one) if links is None else links.union(verify(one))
    label = stars(links)
    end = lambda s: label.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
    rest = pairs.join(one, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left")
    rest = cut(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return links if rest.isEmpty() else links.union(verify(rest))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT, bits: int = BITS, hot_count: int = HOT_COUNT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    small_batches(docs.sparkSession)
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, text_col, k, bits))
    verify = lambda pairs: _links(pairs, docs, id_col, text_col, k, percent)
    rows = cut(_summaries(docs, id_col, text_col, k, percent, levels))
    known = rows.where("n > 0 AND id IS NOT NULL")
    reps = cut(known.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("g").alias("g"), F.first("sketch").alias("sketch")))
    lists = cut(_scan_lists(_postings(docs, id_col, text_col, k, percent, levels, hot_count), percent, hot_count))
    like = _similar(F.col("na"), "sketcha", F.col("nb"), "sketchb", percent)
    in_order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # short lists: pairs of groups, each by its first member; groups of several members, and pairs with one, are lists of members
    firsts = cut(reps.groupBy("g").agg(F.min_by(F.struct("id", "n", "sketch"), "id").alias("x"), F.count("*").alias("m")).select("g", "x.*", "m"))
    side = lambda s: firsts.select(F.col("g").alias(f"g{s}"), *(F.col(c).alias(f"{c}{s}") for c in ("id", "n", "sketch", "m")))
    tried = cut(lists.where("other IS NOT NULL").select(F.col("g").alias("ga"), F.col("other").alias("gb")).distinct().join(side("a"), "ga").join(side("b"), "gb").where(like | (F.col("ma") + F.col("mb") > 2)).select("ga", "gb", F.col("ida").alias("a"), F.col("idb").alias("b"), "ma", "mb"))
    links = _connect(cut(in_order(tried.where("ma + mb = 2"))), None, verify)
    # rows with one id and several sets are one node
    several = cut(known.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("id"))
    if not several.isEmpty():
        same = rows.where("n > 0").join(few(several), "id").join(reps.select("s1", "s2", "n", F.col("id").alias("rep")), ["s1", "s2", "n"])
        links = links.union(same.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    # long lists
    number = lambda c: -F.pmod(c, F.lit(1 << 61)) - 1
    listed = lists.where("other IS NULL").select(F.shiftright("h", _SHARD_BITS).alias("l"), "g", F.col("ni").bitwiseAND((1 << 32) - 1).alias("i"))
    listed = listed.union(firsts.where("m > 1").select(number(F.xxhash64("g")), "g", F.lit(0)))
    listed = cut(listed.union(tried.where("ma + mb > 2").select(number(F.xxhash64("ga", "gb")).alias("l"), F.explode(F.array("ga", "gb")).alias("g"), F.lit(0))))
    drop(lists, firsts, tried)
    if not listed.isEmpty():
        far = _possible(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), percent) & like
        end = lambda df, s: df.select("l", *(F.col(c).alias(s if c == "id" else f"{c}{s}") for c in ("id", "n", "i", "c", "sketch")))
        members = lambda: _open_members(listed, reps, stars(links))
        left = members()
        leads = left.groupBy("l").agg(F.array(*(F.min_by(F.struct("id", "n", "i", "c", "sketch"), F.xxhash64("id", "l", F.lit(i))) for i in range(LEADS))).alias("x"))
        leads = cut(leads.select("l", F.explode(F.array_distinct("x")).alias("x")).select("l", "x.*"))
        pairs = end(left, "a").join(end(leads, "b"), "l").where((F.col("ca") != F.col("cb")) & far)
        few_of = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_set("b")), 1, LEADS).alias("b"))  # a document's leads are bounded by its own prefix
        links = links.union(verify(cut(in_order(few_of.select("a", F.explode("b").alias("b"))))))
        drop(left, leads)
        left = members()
        pairs = end(left, "a").join(end(left, "b"), "l").where((F.col("ca") < F.col("cb")) & far)
        links = _connect(cut(in_order(pairs)), links, verify)
        drop(left)
    nodes = cut(reps.select("s1", "s2", "n", "id").join(stars(links), "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component")))
    some = rows.where("n > 0").join(nodes, ["s1", "s2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    out = some.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _open_members(listed: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """l, id, n, i, c (component), sketch of the members of lists that hold several components, written."""
    of = cut(reps.select("id", "g", "n", "sketch").join(label, "id", "left").select("id", "g", "n", "sketch", F.coalesce("component", "id").alias("c")))
    rows = cut(listed.join(of, "g").select("l", "id", "n", "i", "c", "sketch"))
    several = cut(rows.groupBy("l").agg((F.min("c") != F.max("c")).alias("open")).where("open").select("l"))
    out = cut(rows.join(several, "l"))
    drop(of, rows, several)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Exactly one row of each component: the one with the smallest id (a row without id only if no other has one).

    The nodes are the distinct texts, by a 64-bit hash, so rows may lack ids or share
    them. Of rows with one id and one text any stays. Rows without words stay.
    """
    names = [f"__d{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rows_of = docs.toDF(*names)
    text, i = (F.col(names[docs.columns.index(c)]) for c in (text_col, id_col))
    node = F.xxhash64(text)
    options = {**options, "id_col": "node", "text_col": "text"}
    label = join_components(rows_of.select(node.alias("node"), text.alias("text")), **options).where("n_shingles > 0").select("node", F.col("component_id").alias("c")).distinct()
    # the best row of each text, and how many rows the text and this id have
    rows = rows_of.groupBy(node.alias("node"), i.alias("id")).agg(F.count("*").alias("n"))
    texts = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "n")).alias("best"), F.sum("n").alias("n"))
    texts = cut(texts.join(label, "node"))
    groups = cut(texts.groupBy("c").agg(F.min(F.struct("best.lost", "best.id", "node", "best.n")).alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"))
    known = cut(texts.join(groups, "c").select("node", (F.col("node") == F.col("first.node")).alias("stays"), F.col("first.id").alias("id"), F.col("first.n").alias("n")))
    found = rows_of.withColumn("node", node).join(few(known), "node", "left")
    best = F.col("stays") & i.eqNullSafe(F.col("id"))
    one = found.where(F.col("stays").isNull() | (best & (F.col("n") == 1))).select(*names)
    if not known.where("stays AND n > 1").isEmpty():
        one = one.unionByName(found.where(best & (F.col("n") > 1)).dropDuplicates(["node"]).select(*names))
    return one.toDF(*docs.columns)
