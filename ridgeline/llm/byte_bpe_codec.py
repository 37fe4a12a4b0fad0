"""Byte-level BPE encoding and decoding by a priority queue of merges.

Method: a text is cut at the special tokens and then into pretokens (contractions, runs of letters, of
numbers, of other characters, each with at most one space before it, and white space). The bytes of a
pretoken are symbols of a doubly linked list; a heap holds its mergeable pairs by rank and then
place. The best one is popped, entries whose symbols have been merged meanwhile are skipped, and the two
pairs that a merge makes are pushed, until the heap is empty: n log n for n bytes, also in strings
without a break. Decoding concatenates the vocabulary's byte strings. Pretokens seen before are
looked up in a table of bounded size.

Defined results: a null text counts as empty; the empty text has no ids and decodes to the empty text. The
string of a special token becomes its one id, as the library does it by default. Very long texts are encoded whole.
Repeated rows get the same ids each; ties of rank go to the leftmost pair. Columns of the input are kept; the operator's own columns
replace columns of the same name. Empty tables give empty results. Ids that are not a text's encoding decode
with U+FFFD for bytes that make no character.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import kept_and

#: Pretokens remembered by one Python worker (those of at most so many characters); bounds its memory at about 150 MB.
CACHE_TOKENS, CACHE_CHARS = 500_000, 40

# The pattern that the library cuts texts with, and the code points that the installed `regex` counts
# as letters or numbers and the library, of an older Unicode version, as neither.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LN}]+|\s+(?!\S)|\s+"
_NOT_YET = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEW_CLASS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _NOT_YET)
_NEW = regex.compile(f"[{_NEW_CLASS}]")
_CUT = regex.compile(_PATTERN.replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
#: For texts with code points of _NOT_YET: they count as other characters.
_CUT_NEW = regex.compile(
    f" ?[{_NEW_CLASS}\\S--[\\p{{L}}\\p{{N}}--[{_NEW_CLASS}]]]+".join(
        _PATTERN.replace("{LN}", "").replace("{L}", f"[\\p{{L}}--[{_NEW_CLASS}]]").replace("{N}", f"[\\p{{N}}--[{_NEW_CLASS}]]").split(r" ?[^\s]+")
    ),
    regex.V1,
)


def load_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, checked for what this operator implements."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE without a prefix space is implemented")
    if spec["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("normalisation, dropout, unknown tokens, affixes and direct look-up of words are not implemented")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("only special tokens that match literally are implemented")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class ByteBpeCodec:
    """Encodes and decodes texts with a vocabulary from load_vocabulary()."""

    def __init__(self, vocab: dict):
        ids, chars = vocab["vocab"], byte_characters()
        self.byte_id = [ids[c] for c in chars]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(vocab["merges"])))}
        self.special = vocab["special"]
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        byte_of = {c: b for b, c in enumerate(chars)}
        own = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for piece, i in (ids | self.special).items():
            own[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.piece_len = np.array([len(b) for b in own], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(own), np.uint8)
        self.known: dict[str, bytes] = {}

    def merge(self, own: list[int]) -> list[int]:
        """The ids left after all merges of these ids."""
        n, pairs = len(own), self.pairs
        heap = []
        for i in range(n - 1):
            if found := pairs.get((own[i], own[i + 1])):
                heap.append((found[0], i, own[i], own[i + 1], found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if own[i] != a or j >= n or own[j] != b:  # stale: one of the two is merged already
                continue
            own[i], own[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((new, own[k])):
                    heapq.heappush(heap, (found[0], i, new, own[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((own[h], new))):
                heapq.heappush(heap, (found[0], h, own[h], new, found[1]))
        return [s for s in own if s >= 0]

    def pretoken(self, token: str) -> bytes:
        """Ids of one pretoken, as little-endian unsigned 32-bit integers."""
        byte_id = self.byte_id
        out = np.array(self.merge([byte_id[b] for b in token.encode()]), "<u4").tobytes()
        if len(token) <= CACHE_CHARS:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            self.known[token] = out
        return out

    def _part(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens, pretoken by pretoken."""
        cut = _CUT if text.isascii() or not _NEW.search(text) else _CUT_NEW
        known = self.known.get
        return [known(t) or self.pretoken(t) for t in cut.findall(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(self._part(text))
        out = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [np.array([self.special[part]], "<u4").tobytes()] if i % 2 else self._part(part)
        return b"".join(out)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all decoded texts, and their offsets. ids: of all texts, counts: how many each text has."""
        size, start = self.piece_len[ids], self.piece_start[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.piece_bytes[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        try:
            raw = flat.tobytes()
            raw.decode("utf-8")
            whole = not ((flat[offsets[offsets < len(flat)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:  # a character ends in no text, or in another text than its own
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return flat, offsets.astype(np.int64)


def _ids_column(packed: list[bytes], binary: bool) -> pa.Array:
    counts = np.array([len(p) // 4 for p in packed], np.int64)
    if binary:
        return pa.array(packed, pa.binary())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encode_decode(docs: DataFrame, vocab: dict, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded", keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Add the ids of each text and the text that they decode to (decoded_col None: only the ids).

    packed: the ids as little-endian unsigned 32-bit integers in a binary value, else as an array. keep: the input
    columns that the result has (default: all). One pass over the rows, without a shuffle. A worker
    holds a batch, a piece of about 256 KB of text (or one longer text), and the table of known pretokens.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else []))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    frame = kept_and(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpeCodec(shared.value)
        for batch in batches:
            text = textkit.utf8(batch.column(len(kept)))
            for lo, hi in textkit.pieces(text):
                own = [codec.encode(t) for t in text.slice(lo, hi - lo).to_pylist()]
                out = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + [_ids_column(own, packed)]
                if decoded_col:
                    flat, offsets = codec.decode(np.frombuffer(b"".join(own), "<u4"), np.array([len(p) // 4 for p in own], np.int64))
                    out.append(pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return frame.mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: dict, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each row's ids (an array; null: empty). Raises where an id isn't in the vocabulary."""
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(text_col, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    frame = kept_and(rows, kept, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpeCodec(shared.value)
        for batch in batches:
            own = [np.array(i or [], np.int64) for i in batch.column(len(kept)).to_pylist()]
            ids = np.concatenate([np.zeros(0, np.int64), *own])
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(codec.piece_len):
                raise ValueError("an id outside of the vocabulary")
            flat, offsets = codec.decode(ids, np.array([len(i) for i in own], np.int64))
            text = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), text], names=schema.names)

    return frame.mapInArrow(run, schema)
