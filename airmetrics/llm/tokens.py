"""Exact token ids of whole text columns with the ``tokenizers`` library, one piece at a time.

A byte-level BPE tokenizer first cuts a text into pre-tokens and merges inside each of
them, so ids can be remembered per piece. The text is cut, in numpy, only at places that
are certain to be pre-token limits (a space before a visible character, a change between
letters, digits, other ASCII marks and line ends); every distinct piece is then encoded
once per worker by the library itself. Bytes whose class is not certain (most characters
beyond Latin-1, apostrophes) are never cut next to, they only make a piece longer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from airmetrics.llm.segments import row_slices, segment_hash, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_GLUE, _SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _END = range(7)
_SLICE = 1 << 20


def _classes() -> np.ndarray:
    lut = np.full(256, _GLUE, np.uint8)
    lut[32] = _SPACE
    lut[[9, 10, 11, 12, 13]] = _WHITE
    for b in range(33, 127):
        c = chr(b)
        lut[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK
    return lut


_CLASS = _classes()


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NAMES = _byte_names()
_ONE_TOKEN_RUN = re.compile(rb" ?[A-Za-z\xc3\x80-\xbf]+")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions of certain pre-token limits; every non-empty row starts with one."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)  # U+00C0..U+00FF: letters but for the two arithmetic signs
    lead = lead[lead + 1 < n]
    tail = data[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]
    cls[lead] = _LETTER
    cls[lead + 1] = _LETTER
    nxt = np.empty(n, np.uint8)
    nxt[:-1] = cls[1:]
    ends = offsets[1:] - 1
    nxt[ends[ends >= 0]] = _END
    nxt[n - 1] = _END
    prev = np.empty(n, np.uint8)
    prev[1:] = cls[:-1]
    prev[0] = _END
    visible_prev = (prev >= _LETTER) & (prev < _END)
    visible = (cls >= _LETTER)
    cut = (cls == _SPACE) & (visible_prev | ((nxt >= _LETTER) & (nxt < _END)))
    cut |= (cls == _WHITE) & (visible_prev | ((nxt >= _LETTER) & (nxt < _END)))
    quote = np.zeros(n, bool)
    quote[1:] = data[:-1] == 39
    cut |= visible & ((prev == _WHITE) | (visible_prev & (prev != cls) & ~quote))
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = True
    return np.flatnonzero(cut)


class _SlotTable:
    """64-bit key -> slot number, open addressing in numpy arrays (whole batches at a time)."""

    def __init__(self, capacity: int):
        size = 1 << max(10, (capacity - 1).bit_length())
        self._mask = np.uint64(size - 1)
        self._key = np.zeros(size, np.uint64)
        self._value = np.full(size, -1, np.int32)
        self._count = 0

    def __len__(self) -> int:
        return self._count

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where it is absent."""
        at = key & self._mask
        out = self._value[at].astype(np.int64)
        wrong = np.flatnonzero((self._key[at] != key) & (out >= 0))
        while len(wrong):
            step = (at[wrong] + np.uint64(1)) & self._mask
            at[wrong] = step
            value = self._value[step]
            out[wrong] = value
            wrong = wrong[(self._key[step] != key[wrong]) & (value >= 0)]
        return out

    def insert(self, key: np.ndarray, value: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        at, left = key & self._mask, np.arange(len(key))
        while len(left):
            spot = at[left]
            free = self._value[spot] < 0
            put = left[free]
            self._key[at[put]], self._value[at[put]] = key[put], value[put]
            lost = self._key[spot] != key[left]
            left = left[lost]
            at[left] = (at[left] + np.uint64(1)) & self._mask
        self._count += len(key)


class PieceEncoder:
    """Encodes Arrow text columns; keeps the ids of up to ``limit`` distinct pieces (then starts afresh)."""

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._limit = limit
        self._reset()

    def _reset(self) -> None:
        self._slot = _SlotTable(2 * self._limit)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._begin = np.zeros(1 << 16, np.int64)
        self._length = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        model, rest = self._tok.model, []
        for i, p in enumerate(pieces):
            if len(p) < 200 and _ONE_TOKEN_RUN.fullmatch(p):  # one pre-token: straight to the merges
                out[i] = [t.id for t in model.tokenize(p.decode("latin-1").translate(_NAMES))]
            else:
                rest.append(i)
        for i, e in zip(rest, self._tok.encode_batch([pieces[i].decode() for i in rest],
                                                     add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids = self._encode(pieces)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(length.sum()))
        at = len(self._slot)
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while at + len(ids) > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
        self._ids[self._used:self._used + len(flat)] = flat
        self._begin[at:at + len(ids)] = self._used + np.cumsum(length) - length
        self._length[at:at + len(ids)] = length
        self._used += len(flat)
        self._slot.insert(keys, np.arange(at, at + len(keys)))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = piece_starts(data, offsets)
        if len(start) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = np.diff(np.append(start, len(data)))
        key = segment_hash(data, start, size)
        slot = self._slot.find(key)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
            if len(self._slot) + len(new) > self._limit:
                self._reset()
                return self._slice(data, offsets)
            raw, first = data.tobytes(), missing[first]
            at = len(self._slot)
            self._add(new, [raw[a:a + n] for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)])
            slot[missing] = at + inverse
        per = self._length[slot]
        ends = np.cumsum(per)
        take = np.repeat(self._begin[slot] - (ends - per), per)
        take += np.arange(len(take))
        before = np.concatenate([[0], ends])
        return self._ids[take], before[np.searchsorted(start, offsets)]

    def batches(self, column: pa.Array):
        """Yield (first row, ids, row offsets into ids) for consecutive runs of rows of the column."""
        data, offsets = text_bytes(column)
        for i, j in row_slices(offsets, _SLICE):
            part, rel = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            if len(part) <= 4 * _SLICE:
                yield i, *self._slice(part, rel)
                continue
            pieces, at = [], 0  # one very long row: cut at limits of windows
            while at < len(part):
                width = 2 * _SLICE
                while True:
                    window = part[at:at + width]
                    if at + width >= len(part):
                        stop = len(window)
                        break
                    marks = piece_starts(window, np.array([0, len(window)]))
                    stop = int(marks[marks < len(window) - 2][-1])
                    if stop:
                        break
                    width *= 2
                pieces.append(self._slice(window[:stop], np.array([0, stop]))[0])
                at += stop
            ids = np.concatenate(pieces)
            yield i, ids, np.array([0, len(ids)])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file (kept between tasks of one worker)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
