"""Vectorised word and shingle hashing over Arrow string batches.

Everything works on the UTF-8 bytes of whole texts. A word is a maximal run of
bytes other than space and 0x09-0x0D; those bytes never occur inside a
multi-byte character, so byte runs are exactly `[^\\x20\\x09-\\x0D]+`.

Two sequences count as equal when their 64-bit hashes (128 bits where stated by
the caller) are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are processed in pieces of about this many bytes, so that the working
#: arrays stay within a core's cache. One longer text is one piece.
CHUNK_BYTES = 1 << 18

_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1)
_INV = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _WORD_BASE)}
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


@dataclass
class Words:
    """The words of some texts: byte bounds, and for each text its range of words."""

    data: np.ndarray  # uint8, the texts' bytes
    offsets: np.ndarray  # len(texts) + 1, byte bounds of the texts within data
    starts: np.ndarray  # byte bounds of the words
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1, word bounds of the texts
    row: int  # index of the first text within the batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(_INV[int(_BASE)], n)[self.starts])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words (across text bounds too: select the valid ones)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(_INV[int(_WORD_BASE)], n - k + 1))


def span_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the word sequences hashes[lo:hi], their lengths included."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, n), out=sums[1:])
    own = (sums[hi] - sums[lo]) * powers(_INV[int(_WORD_BASE)], n + 1)[lo]
    return mix(mix(own) ^ (hi - lo).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a large_string array, without a copy."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `most` bytes each."""
    _, offsets = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split(own: np.ndarray, off: np.ndarray, row: int = 0) -> Words:
    """Split texts, given as bytes with offsets from 0, into words."""
    solid = ~WHITE[own]
    begin, end = solid.copy(), np.zeros(len(own) + 1, bool)
    begin[1:] &= ~solid[:-1]
    bounds = off[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(own))]
    begin[bounds] = solid[bounds]
    end[1:-1] = solid[:-1] & ~solid[1:]
    if len(own):
        end[-1] = solid[-1]
    end[bounds] |= solid[bounds - 1]
    starts = np.flatnonzero(begin)
    return Words(own, off, starts, np.flatnonzero(end), np.searchsorted(starts, off), row)


def words(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """Split whole texts into words, piece by piece. column: as from utf8()."""
    data, offsets = buffers(column)
    for lo, hi in pieces(column, most):
        yield split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)


def valid_windows(first: np.ndarray, k: int, n_grams: int) -> np.ndarray:
    """Mask over the grams of k words: those that lie within one text."""
    ok = np.ones(n_grams, bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n_grams)]
        ok[at] = False
    return ok


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """For each of n words the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
