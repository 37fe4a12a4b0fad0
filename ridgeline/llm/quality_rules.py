"""Quality rules on repetition, by suffix arrays.

Method: the suffixes of each text that has a repeat of MIN_REPEAT words at all are
sorted by prefix doubling, many texts at once. The longest common prefixes of neighbours in the suffix array, read off
the doubling ranks, bound the intervals of maximal repeated substrings; each
suffix reaches as far as the longer of its two. The union of these spans gives the
covered words; the longest common prefix is the longest repeat (copies may
overlap). Both are limited, besides base rules on length and repetition.

Defined results: a null or empty text has no words, all counts 0, fails the base
and is not kept. Very long texts are handled whole, one at a time. Input columns
are kept; the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import kept_and

MIN_REPEAT = 8
#: The method's limits: percent of a text's words that repeats may cover, and the
#: longest repeat in words: this many, or this percent of the text if that is more.
MAX_COVERED_PCT, MAX_LONGEST, MAX_LONGEST_PCT = 25, 64, 20
#: The base rules.
MIN_WORDS, BASE_COVERED_PCT = 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def repeats(hashes: np.ndarray, first: np.ndarray, k: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether a repeat of k or more words covers it, and for each text its longest repeat."""
    n, texts = len(hashes), len(first) - 1
    covered, longest = np.zeros(n, bool), np.zeros(texts, np.int64)
    g = textkit.grams(hashes, k)
    if not len(g):
        return covered, longest
    pos = np.flatnonzero(textkit.valid_windows(first, k, len(g)))
    of = textkit.owner(first, n)
    key = textkit.mix(g[pos] ^ textkit.mix(of[pos].astype(np.uint64) + np.uint64(1)))
    ks = np.sort(key)
    twice = ks[1:][ks[1:] == ks[:-1]]
    if not len(twice):
        return covered, longest
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    has_repeat = np.zeros(texts, bool)
    has_repeat[of[pos[twice[at] == key]]] = True
    # the suffix array of the texts that have a repeat
    suffix = np.flatnonzero(has_repeat[of])
    end = first[of + 1]
    values = textkit.mix(hashes[suffix] ^ textkit.mix(of[suffix].astype(np.uint64)))
    order = np.argsort(values, kind="stable")
    suffix, values = suffix[order], values[order]
    rank = np.zeros(n + 1, np.int64)  # rank of the first `span` words at a place; 0: no such place
    rank[suffix] = 1 + np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    levels, span = [rank], 1
    while True:
        r = levels[-1]
        ahead = suffix + span
        second = np.where(ahead < end[suffix], r[np.minimum(ahead, n)], 0)
        order = np.lexsort((second, r[suffix]))
        suffix, second = suffix[order], second[order]
        a = r[suffix]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (second[1:] != second[:-1])])
        if new.all():
            break
        nxt = np.zeros(n + 1, np.int64)
        nxt[suffix] = np.cumsum(new)
        levels.append(nxt)
        span *= 2
    # longest common prefixes of neighbours in the suffix array
    i, j = suffix[:-1].copy(), suffix[1:].copy()
    at = np.flatnonzero(of[i] == of[j])
    i, j = i[at], j[at]
    stop = end[i] if len(i) else i
    lcp_own = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, step = levels[level], 1 << level
        fits = np.maximum(i, j) + step <= stop
        ok = fits & (r[np.minimum(i, n)] == r[np.minimum(j, n)])
        i, j, lcp_own = i + ok * step, j + ok * step, lcp_own + ok * step
    lcp = np.zeros(len(suffix) + 1, np.int64)
    lcp[at + 1] = lcp_own
    reach = np.maximum(lcp[:-1], lcp[1:])
    suffix, reach = suffix[reach >= k], reach[reach >= k]
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, suffix, 1)
    np.add.at(steps, suffix + reach, -1)
    covered = np.cumsum(steps)[:n] > 0
    np.maximum.at(longest, of[suffix], reach)
    return covered, longest


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def measure(w: textkit.Words, k: int = MIN_REPEAT) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All counts of each text, and for each word whether a repeat covers it."""
    data, off = w.data, w.offsets
    solid = ~textkit.WHITE[data]
    covered, longest = repeats(w.hashes(), w.first, k)
    cuts = np.unique(np.concatenate([off[:-1], off[1:], np.flatnonzero(data == 10) + 1]))
    dup = np.zeros(len(w), np.int64)
    if len(data):
        lo = cuts[:-1]
        hi = cuts[1:].copy()
        hi -= data[hi - 1] == 10
        has_word = np.searchsorted(w.starts, hi) > np.searchsorted(w.starts, lo)
        lo, hi = lo[has_word], hi[has_word]
        text = np.searchsorted(off, lo, "right") - 1
        bytes_hash = textkit.span_hash(textkit._BYTE[data], lo, hi)
        distinct = np.unique(np.stack([text.astype(np.uint64), bytes_hash]), axis=1)[0].astype(np.int64)
        dup = np.bincount(text, minlength=len(w)) - np.bincount(distinct, minlength=len(w))
    return {
        "n_words": np.diff(w.first),
        "word_chars": _per_text(solid & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_text(_SYMBOL[data], off),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": _per_text(covered, w.first),
        "longest_repeat": longest,
    }, covered


def verdict(c: dict[str, np.ndarray], max_covered_pct: int = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST, max_longest_pct: int = MAX_LONGEST_PCT) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > BASE_COVERED_PCT * c["n_words"])
    over = (100 * c["n_repeat_words"] > max_covered_pct * c["n_words"]) | (c["longest_repeat"] > np.maximum(max_longest, c["n_words"] * max_longest_pct // 100))
    return failed, ~failed & ~over


def apply_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, spans_col: str | None = "repeat_spans", **limits: int) -> DataFrame:
    """Add the counts, the repeated spans (word numbers, end exclusive), base_failed and kept; no shuffle."""
    own = [*COUNTS, "base_failed", "kept"] + [spans_col] * bool(spans_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    spans_type = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())] + ([T.StructField(spans_col, spans_type)] if spans_col else []))
    frame = kept_and(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textkit.words(textkit.utf8(batch.column(len(kept)))):
                counts, covered = measure(w)
                failed, keeps = verdict(counts, **limits)
                columns = [batch.column(i).slice(w.row, len(w)) for i in range(len(kept))]
                columns += [pa.array(counts[c].astype(np.int64)) for c in COUNTS] + [pa.array(failed), pa.array(keeps)]
                if spans_col:
                    of = textkit.owner(w.first, len(covered))
                    cut = np.ones(len(covered), bool)
                    cut[1:] = of[1:] != of[:-1]
                    before = np.concatenate([[False], covered[:-1]])
                    begin = np.flatnonzero(covered & (cut | ~before))
                    end = np.flatnonzero(covered & np.concatenate([cut[1:] | ~covered[1:], [True]])[: len(covered)]) + 1
                    base = w.first[of[begin]] if len(begin) else begin
                    structs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["begin", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, w.first).astype(np.int32)), structs))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *own])

    return frame.mapInArrow(run, schema)
