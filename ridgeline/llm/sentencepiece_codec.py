"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Method: a text is cut before each run of spaces that follows another character
and around line ends and tabs; no vocabulary piece spans such a cut (checked when the vocabulary is loaded), so
the segments encode independently. The characters of all new segments of a
batch lie in one flat numpy array. Each round finds the best-ranked pair of every
segment (segmented minimum), merges its leftmost non-overlapping occurrences in
all segments at once, compacts the array, and ends when no pair is left.
Characters without a piece become byte pieces. Of a vocabulary in which a merge can make
a better pair, as this one, a round merges only the leftmost best pair of each segment;
unbroken strings of more than LONG_SEGMENT symbols are then merged from a heap.

Defined results: a null text counts as empty; the empty text has no ids and
decodes to the empty text. U+2581 in a text decodes to a space, as in the library.
Very long texts are encoded whole. Repeated rows get the same ids each. Columns of the
input are kept; the operator's own columns replace columns of the same name. Empty tables
give empty results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import kept_and

#: Segments and ids remembered by one Python worker; bounds the cache at about 40 MB. Most segments of a text come once only; what is
#: forgotten is encoded again. A worker keeps its memory for the stages after this one.
CACHE_SEGMENTS, CACHE_IDS = 120_000, 3_000_000
_NONE = np.iinfo(np.int32).max
#: Segments of more symbols (unbroken strings, not words) are merged one by one from a heap, in time n log n; the outcome is the same.
LONG_SEGMENT = 256
_SEGMENT = re.compile("[\n\t]+| +[^ \n\t]*|[^ \n\t]+")
_SPACE = "▁"


def load_vocabulary(path: str) -> dict:
    """The model's pieces, scores and kinds, checked for what this operator implements."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only identity normalisation with a dummy prefix is implemented")
    kinds = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
    vocab = {
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "kinds": [kinds[p.type] for p in model.pieces],
        "model_type": train.model_type,
    }
    if "user" in vocab["kinds"] or "unused" in vocab["kinds"] or vocab["kinds"].count("byte") != 256:
        raise ValueError("only vocabularies of normal pieces with byte fallback are implemented")
    if any(re.search(f"[^{_SPACE}]{_SPACE}|[\n\t]", p) for p in vocab["pieces"]):
        raise ValueError("a piece spans the end of a word")
    return vocab


class BpeCodec:
    """Encodes and decodes batches of texts with a vocabulary from load_vocabulary()."""

    def __init__(self, vocab: dict):
        pieces, kinds = vocab["pieces"], vocab["kinds"]
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        n = len(pieces)
        # characters that only occur inside longer pieces get symbols of their own beyond the vocabulary
        chars = sorted({c for p in normal for c in p})
        extra = {c: n + 1 + i for i, c in enumerate(c for c in chars if c not in normal)}
        self.unknown = n
        self.char_symbol = np.full(0x110000, n, np.int32)
        for c in chars:
            self.char_symbol[ord(c)] = normal.get(c, extra.get(c))
        symbol = normal | extra
        self.width = n + 1 + len(extra)
        ranks = {s: r for r, s in enumerate(sorted({vocab["scores"][i] for i in normal.values()}, reverse=True))}
        rank = {i: ranks[vocab["scores"][i]] for i in normal.values()}
        keys, merged = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_piece = np.array(merged, np.int32)[order]
        self.rank = np.full(self.width, -1, np.int32)
        self.rank[list(rank)] = list(rank.values())
        # merging all occurrences of a pair at once equals one at a time if no merge makes a better pair
        left, right = self.pair_keys // self.width, self.pair_keys % self.width
        best_part = np.maximum(self.rank[left], self.rank[right])
        self.at_once = bool((self.rank[self.pair_piece] > best_part).all())
        byte_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.byte_id = np.array([byte_of[b] for b in range(256)], np.int32)
        self.char_of_symbol = {v: k for k, v in extra.items()}
        own = [b"" if k == "control" else b" \xe2\x81\x87 " if k == "unknown" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(_SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.piece_len = np.array([len(b) for b in own], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(own), np.uint8)
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.is_control = np.array([k == "control" for k in kinds])
        self._pairs: dict[int, tuple[int, int]] | None = None  # for long segments, made when the first one comes
        self._forget()

    # encoding

    def _forget(self) -> None:
        """Empty the cache: a row per segment, its ids at begins[row] .. begins[row + 1] of ids."""
        self._row: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._begins = np.zeros(1 << 14, np.int64)

    def _remember(self, segments: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        base, used = len(self._row), int(self._begins[len(self._row)])
        if used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids[:used], np.zeros(used + 2 * len(ids), np.int32)])
        if base + len(segments) + 1 > len(self._begins):
            self._begins = np.concatenate([self._begins[: base + 1], np.zeros(base + 2 * len(segments), np.int64)])
        self._ids[used : used + len(ids)] = ids
        self._begins[base + 1 : base + len(segments) + 1] = used + np.cumsum(lens)
        self._row.update(zip(segments, range(base, base + len(segments)), strict=True))

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; _NONE where the pair is no piece."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        piece = np.where(self.pair_keys[at] == key, self.pair_piece[at], -1)
        return np.where(piece >= 0, self.rank[piece], _NONE).astype(np.int32), piece

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all segments (numbers that don't decrease) to the end. Returns symbols and their segments, in order."""
        starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
        lens = np.diff(np.append(starts, len(seg)))
        long = lens > LONG_SEGMENT
        if not long.any():
            return self._merge_rounds(sym, seg)
        short = np.repeat(~long, lens)
        parts = [self._merge_rounds(sym[short], seg[short])]
        for at, n in zip(starts[long].tolist(), lens[long].tolist(), strict=True):
            own = self._merge_from_heap(sym[at : at + n])
            parts.append((own, np.full(len(own), seg[at])))
        sym, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _merge_from_heap(self, sym: np.ndarray) -> np.ndarray:
        """The same merges in one long segment: always the best pair, of equal ones the leftmost."""
        rank, piece = self._lookup(sym[:-1], sym[1:])
        some = np.flatnonzero(piece >= 0)
        own, n = sym.tolist(), len(sym)
        heap = list(zip(rank[some].tolist(), some.tolist(), sym[some].tolist(), sym[some + 1].tolist(), piece[some].tolist(), strict=True))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if self._pairs is None:
            self._pairs = dict(zip(self.pair_keys.tolist(), zip(self.rank[self.pair_piece].tolist(), self.pair_piece.tolist(), strict=True), strict=True))
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if own[i] != a or j >= n or own[j] != b:  # one of the two is merged already
                continue
            own[i], own[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := self._pairs.get(new * self.width + own[k]):
                    heapq.heappush(heap, (found[0], i, new, own[k], found[1]))
            if (h := before[i]) >= 0 and (found := self._pairs.get(own[h] * self.width + new)):
                heapq.heappush(heap, (found[0], h, own[h], new, found[1]))
        return np.array([s for s in own if s >= 0], np.int32)

    def _merge_rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all segments to the end, in rounds over all of them. Returns symbols and their segments, in order."""
        done_sym, done_seg = [], []
        rank = np.full(len(sym), _NONE, np.int32)
        piece = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], piece[inner] = self._lookup(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            lens = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (over := least == _NONE).any():
                gone = np.repeat(over, lens)
                done_sym.append(sym[gone])
                done_seg.append(seg[gone])
                sym, seg, rank, piece = sym[~gone], seg[~gone], rank[~gone], piece[~gone]
                least, lens = least[~over], lens[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]  # of overlapping pairs every second, from the left
            if not self.at_once:
                at = at[np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # stays _NONE at the end of a segment
            place = np.cumsum(keep) - 1
            sym, seg, rank, piece = sym[keep], seg[keep], rank[keep], piece[keep]
            now = place[at]
            near = np.zeros(len(sym) + 1, bool)
            near[now] = True
            near[now - 1] = True  # of now = 0 the last place, which is unused
            touched = np.flatnonzero(near[: len(sym) - 1])
            same = seg[touched] == seg[touched + 1]
            rank[touched[~same]] = _NONE
            touched = touched[same]
            rank[touched], piece[touched] = self._lookup(sym[touched], sym[touched + 1])
            if len(sym):
                rank[-1] = _NONE
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, and the number of ids of each."""
        flat = "".join(segments).replace(" ", _SPACE)
        points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        seg = np.repeat(np.arange(len(segments)), lens)
        sym = self.char_symbol[points]
        # an unknown character keeps its code point below zero until the end
        sym = np.where(sym == self.unknown, -1 - points.astype(np.int64), sym)
        known = sym >= 0
        if known.all():
            out, of = self._merge(sym.astype(np.int32), seg)
        else:  # unknown characters never merge: what lies between them are segments of their own
            part = np.cumsum(~known)
            group = np.cumsum(np.concatenate([[0], (seg[1:] != seg[:-1]) | (part[1:] != part[:-1])]))
            got, of_group = self._merge(sym[known].astype(np.int32), group[known])
            of_all = np.concatenate([of_group, group[~known]])
            out = np.concatenate([got.astype(np.int64), sym[~known]])
            order = np.lexsort((out >= 0, of_all))  # in its group the unknown character is the first
            out, of_all = out[order], of_all[order]
            seg_of_group = np.zeros(int(group[-1]) + 1, np.int64)
            seg_of_group[group] = seg
            of = seg_of_group[of_all]
        if (bad := np.flatnonzero((out < 0) | (out >= self.unknown))).size:
            spelled = [(chr(-1 - int(out[i])) if out[i] < 0 else self.char_of_symbol[int(out[i])]).encode() for i in bad]
            reps = np.ones(len(out), np.int64)
            reps[bad] = [len(b) for b in spelled]
            place = np.concatenate([[0], np.cumsum(reps)[:-1]])
            out, of = np.repeat(out, reps), np.repeat(of, reps)
            for i, b in zip(place[bad], spelled, strict=True):
                out[i : i + len(b)] = self.byte_id[np.frombuffer(b, np.uint8)]
        return out.astype(np.int32), np.bincount(of, minlength=len(segments)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each text."""
        cut = [_SEGMENT.findall(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        if len(self._row) > CACHE_SEGMENTS or len(self._ids) > CACHE_IDS:
            self._forget()
        row = self._row
        new: dict[str, None] = {}
        for segs in cut:
            new.update(dict.fromkeys(s for s in segs if s not in row))
        if new:
            segments = list(new)
            self._remember(segments, *self._segments(segments))
        n_segs = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter((row[s] for segs in cut for s in segs), np.int64, int(n_segs.sum()))
        lens = self._begins[rows + 1] - self._begins[rows]
        flat = self._ids[_spread(self._begins[rows], lens)]
        seg_ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], np.cumsum(n_segs)])
        return flat, np.diff(seg_ends[bounds])

    # decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all decoded texts, and their offsets. ids, counts: as from encode()."""
        size = self.piece_len[ids]
        flat = self.piece_bytes[_spread(self.piece_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        offsets = ends[bounds]
        # the dummy prefix: one space at the start of the first piece that isn't a control piece
        keep = np.ones(len(flat), bool)
        full = np.flatnonzero(np.diff(offsets) > 0)
        first = offsets[full]
        first_piece = ids[np.searchsorted(ends, first, "right") - 1] if len(full) else np.zeros(0, int)
        strip = (flat[first] == 0x20) & ~self.is_byte[first_piece] & (first_piece != 0) if len(full) else np.zeros(0, bool)
        keep[first[strip]] = False
        cut = np.zeros(len(counts), np.int64)
        cut[full[strip]] = 1
        flat, offsets = flat[keep], offsets - np.concatenate([[0], np.cumsum(cut)])
        if self.is_byte[ids].any():
            raw = flat.tobytes()
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                texts = [_lenient(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                flat = np.frombuffer(b"".join(texts), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return flat, offsets.astype(np.int64)


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1 for all i, joined."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return np.arange(total) + np.repeat(starts - begin, lens)


def _lenient(raw: bytes) -> bytes:
    """Replace each byte that belongs to no well-formed character by U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out).encode()


def encode_decode(docs: DataFrame, vocab: dict, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each text and the text that they decode to.

    keep: the input columns that the result has (default: all). One pass over
    the rows, without a shuffle. A worker holds a batch, a piece of about 256 KB of text
    (or one longer text), and the segment cache.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    frame = kept_and(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(shared.value)
        for batch in batches:
            text = textkit.utf8(batch.column(len(kept)))
            for lo, hi in textkit.pieces(text):
                ids, counts = codec.encode(text.slice(lo, hi - lo).to_pylist())
                flat, offsets = codec.decode(ids, counts)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                    + [pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)), pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))],
                    names=[*kept, ids_col, decoded_col],
                )

    return frame.mapInArrow(run, schema)
