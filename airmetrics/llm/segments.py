"""Vectorised splitting of UTF-8 text columns into words, with 64-bit word hashes.

Helpers for the operators that look at every word of every document. A text column
arrives as an Arrow string array; its bytes stay one flat numpy buffer, a byte class
table says which bytes belong to a word, and every word gets a multilinear 64-bit hash
(one random odd multiplier per byte position), so no Python object is made per word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_POSITIONS = 1024
_rng = np.random.default_rng(20240229)
_POWER = _rng.integers(1, 2**63, _POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def whitespace_words() -> np.ndarray:
    """Byte classes for words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    lut = np.arange(256, dtype=np.uint8)
    lut[[9, 10, 11, 12, 13, 32]] = 0
    lut[0] = 255  # NUL belongs to a word; 0 marks a separator and byte 255 is never in UTF-8
    return lut


def plain_words() -> np.ndarray:
    """Byte classes for lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z lowered)."""
    lut = np.zeros(256, dtype=np.uint8)
    lut[128:] = np.arange(128, 256)
    lut[48:58] = np.arange(48, 58)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    return lut


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat bytes, row offsets of length rows+1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return flat[:0], np.zeros(len(column) + 1, np.int64)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of rows: byte start and end (in the slice), hash, first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_first: np.ndarray  # length rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_first)


def segment_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of byte segments that follow one another in ``data`` (it holds nothing else)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    offset = np.arange(len(data), dtype=np.int64)
    offset -= np.repeat(start, length)
    value = _BYTE[data]
    if length.max() <= _POSITIONS:
        value *= _POWER[offset]
    else:  # positions beyond the table take the table again under another odd factor
        value *= _POWER[offset % _POSITIONS] * (2 * (offset // _POSITIONS).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(value, start) + length.astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> Words:
    """Words of the rows ``data[offsets[i]:offsets[i+1]]``; a word never crosses rows."""
    mapped = lut[data]
    inside = mapped != 0
    n = len(data)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = False
    edge[n:] = False
    edge[1:n] = inside[1:] & ~inside[:-1]
    if n:
        edge[0] = inside[0]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < n]
        edge[cuts] |= inside[cuts]
    start = np.flatnonzero(edge[:n])
    packed = mapped[inside]
    before = np.cumsum(inside, dtype=np.int64)
    first = before[start] - 1 if len(start) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(packed)))
    return Words(start, start + length, segment_hash(packed, first, length),
                 np.searchsorted(start, offsets))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values (length n-k+1); runs may cross rows, the caller masks those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _MIX
        out += h[i:i + n]
    return mix(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values (length n-w+1), by doubling."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = w - span
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v
