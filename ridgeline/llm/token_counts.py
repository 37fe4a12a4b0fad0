"""Unigram token counts by count-only Viterbi.

Method: an Aho-Corasick automaton enumerates every vocabulary match in the new
segments of a batch; dynamic programming over all these segments at once keeps,
for each position, only the best score and its number of pieces (no back
pointers, no ids). Tie rules are those of the published unigram encoder: at equal score the piece that starts earlier wins; a character without
a piece of its own may be unknown at the lowest score less 10, after all pieces,
and counts as one piece for each of its bytes.

Whole-number scores add up exactly, so no rounding decides between paths, and a text is cut
where no piece can span: before a run of spaces, around line ends and tabs; segments
are remembered. Any other scores are added as the library does, in single precision from
the text's begin to its end (a piece's score is added and compared in double precision
and then rounded), since there rounding may decide; such texts are walked one by one.

The public tokenizers hold no unigram model; the query uses the pieces and scores of a
BPE model as a unigram vocabulary.

Defined results: a null or empty text has 0 tokens and score 0. Very long texts are
counted whole. Repeated rows get the same counts each. Input columns are kept; the operator's
own columns replace columns of the same name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import kept_and
from ridgeline.llm.sentencepiece_codec import _SEGMENT, _SPACE

#: Segments remembered by one Python worker; bounds its memory at about 100 MB.
CACHE_SEGMENTS = 600_000
UNKNOWN_PENALTY = 10
_FAR = np.iinfo(np.int64).max // 4


class UnigramCounter:
    """Counts the pieces of the best segmentation. vocab: from sentencepiece_codec.load_vocabulary()."""

    def __init__(self, vocab: dict):
        import ahocorasick

        costs = {p: -s for p, s, k in zip(vocab["pieces"], vocab["scores"], vocab["kinds"], strict=True) if k == "normal"}
        self.whole = all(c == int(c) and c >= 0 for c in costs.values())
        self.unknown = int(max(costs.values())) + UNKNOWN_PENALTY if self.whole else 0
        self.scores = [float(np.float32(-c)) for c in costs.values()]
        self.unknown_score = np.float32(min(self.scores)) - np.float32(UNKNOWN_PENALTY)
        self.automaton = ahocorasick.Automaton()
        pieces = list(costs)
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.cost = np.array([int(costs[p]) for p in pieces], np.int64) if self.whole else None
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._cost = np.zeros(1 << 14, np.int64)
        self._count = np.zeros(1 << 14, np.int64)

    def _viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best cost and its number of pieces for each segment."""
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        flat = "\0".join(segments).replace(" ", _SPACE)  # the separator keeps matches within a segment
        begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        found = np.array(list(self.automaton.iter(flat)), np.int64).reshape(-1, 2)
        last, piece = found[:, 0], found[:, 1]
        seg = np.searchsorted(begin, last, "right") - 1
        ok = last - self.size[piece] + 1 >= begin[seg]
        last, piece, seg = last[ok], piece[ok], seg[ok]
        at = last - begin[seg] + 1  # position after the piece
        size = self.size[piece]
        has_single = np.zeros(len(flat) + 1, bool)
        has_single[last[size == 1]] = True
        width = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        width = 1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF)
        # best[begin + j]: the cost of the first j characters
        best = np.full(len(flat) + 2, _FAR, np.int64)
        count = np.zeros(len(flat) + 2, np.int64)
        best[begin] = 0
        order = np.lexsort((-size, at))
        seg, at, size, cost = seg[order], at[order], size[order], self.cost[piece[order]]
        cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (size[1:] != size[:-1])])) if len(at) else np.zeros(0, int)
        ends = np.append(cuts[1:], len(at))
        by_len = np.argsort(lens, kind="stable")
        sorted_lens = lens[by_len]
        k = 0
        for j in range(1, int(lens.max(initial=0)) + 1):
            while k < len(cuts) and at[cuts[k]] == j:  # longest piece first: at a tie it stays
                a, b = cuts[k], ends[k]
                to = begin[seg[a:b]] + j
                old = to - size[a]
                new = best[old] + cost[a:b]
                better = new < best[to]
                to, old = to[better], old[better]
                best[to] = new[better]
                count[to] = count[old] + 1
                k += 1
            own = begin[by_len[np.searchsorted(sorted_lens, j) :]] + j
            own = own[~has_single[own - 1]]
            new = best[own - 1] + self.unknown
            better = new < best[own]
            own = own[better]
            best[own] = new[better]
            count[own] = count[own - 1] + width[own - 1]
        return best[begin + lens], count[begin + lens]

    def _walk(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of one text, in the library's arithmetic."""
        t = _SPACE + text.replace(" ", _SPACE)
        best, count = [0.0] * (len(t) + 1), [0] * (len(t) + 1)
        matches = self.automaton.iter(t)
        last, piece = next(matches, (-1, -1))
        for at in range(len(t)):
            found, single = None, False
            while last == at:  # the longest piece, which starts first, comes first
                size = int(self.size[piece])
                score = self.scores[piece] + best[at + 1 - size]
                if found is None or score > found:
                    found, count[at + 1] = float(np.float32(score)), count[at + 1 - size] + 1
                single = single or size == 1
                last, piece = next(matches, (-1, -1))
            if not single:
                score = float(self.unknown_score + np.float32(best[at]))
                if found is None or score > found:
                    found, count[at + 1] = score, count[at] + len(t[at].encode())
            best[at + 1] = found
        return count[-1], best[-1]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of pieces and the total cost (the score's negative)."""
        if not self.whole:
            found = [self._walk(t) if t else (0, 0.0) for t in texts]
            return np.array([n for n, _ in found], np.int64), -np.array([s for _, s in found], float)
        cut = [_SEGMENT.findall(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        if len(self._row) > CACHE_SEGMENTS:
            self._forget()
        row = self._row
        new: dict[str, None] = {}
        for segs in cut:
            new.update(dict.fromkeys(s for s in segs if s not in row))
        if new:
            segments, base = list(new), len(row)
            row.update(zip(segments, range(base, base + len(segments)), strict=True))
            if len(row) > len(self._cost):
                self._cost, self._count = (np.concatenate([x[:base], np.zeros(len(row), np.int64)]) for x in (self._cost, self._count))
            self._cost[base : len(row)], self._count[base : len(row)] = self._viterbi(segments)
        n_segs = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter((row[s] for segs in cut for s in segs), np.int64, int(n_segs.sum()))
        bounds = np.concatenate([[0], np.cumsum(n_segs)])
        sums = [np.concatenate([[0], np.cumsum(x[rows])])[bounds] for x in (self._count, self._cost)]
        return np.diff(sums[0]), np.diff(sums[1])


def count_tokens(docs: DataFrame, vocab: dict, text_col: str = "text", count_col: str = "n_tokens", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the number of pieces and the score of the best segmentation of each whole text; no shuffle."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (count_col, score_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(count_col, T.LongType()), T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    frame = kept_and(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for batch in batches:
            text = textkit.utf8(batch.column(len(kept)))
            for lo, hi in textkit.pieces(text):
                counts, costs = counter.count(text.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + [pa.array(counts), pa.array(0.0 - costs)], names=[*kept, count_col, score_col])

    return frame.mapInArrow(run, schema)
