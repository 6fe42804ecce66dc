"""Operator 4: substring de-duplication with an FM-index per shard.

Words are runs of characters other than ASCII white space, unchanged. A window of ``length``
words whose word sequence starts anywhere else too (same document included) is repeated;
every word of a repeated window is removed, judged on the input. ``repeats`` deals equal
windows to one shard. In a shard:

* the contexts, each with an end mark of its own, are sorted by suffixes (prefix doubling);
  the Burrows-Wheeler transform of that order is stored as a wavelet matrix (one bit vector
  per symbol bit, packed in 64-bit words with counts per word): the FM-index;
* each context is streamed backwards through the index: a backward-search step (``C`` plus a
  rank on the wavelet matrix) leads from the row of a suffix to the row of the suffix one
  word longer;
* a bit vector marks where neighbouring suffixes share less than ``length`` words; the row of
  a suffix and the marks around it give the interval of all suffixes with the same ``length``
  words: a matching statistic of ``length`` or more. Windows whose interval weighs two or more are
  reported, as intervals of windows.

Defined results: null and empty texts have no words; texts shorter than a window keep all;
repeated rows are copies of one another, both lose their words; null ids are kept as null; empty tables
give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airmetrics.llm.repeats import Units, covered, repeated_ranges, with_spans
from airmetrics.llm.segments import row_slices, text_bytes, whitespace_words, words_of

_U64 = np.uint64


def _cut_words(data, offsets):
    w = words_of(data, offsets, whitespace_words())
    return w.hash, w.row_first, w.start, w.end


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64)
        padded = np.zeros(n * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(n, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> 6
        low = (_U64(1) << (at & 63).astype(_U64)) - _U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols below 2^levels."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.vectors, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.vectors.append(BitVector(bit))
            zero = symbols[bit == 0]
            self.zeros.append(len(zero))
            symbols = np.concatenate([zero, symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in front of ``at``; ``first``: where the symbol's run begins after the last level."""
        p = at
        for i, vector in enumerate(self.vectors):
            one = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            r = vector.rank(p)
            p = np.where(one, self.zeros[i] + r, p - r)
        return p - first[symbol]

    def starts(self, n_symbols: int) -> np.ndarray:
        """Where each symbol's run begins after the last level."""
        symbol = np.arange(n_symbols)
        p = np.zeros(n_symbols, np.int64)
        for i, vector in enumerate(self.vectors):
            one = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            r = vector.rank(p)
            p = np.where(one, self.zeros[i] + r, p - r)
        return p


class FMIndex:
    """FM-index of several sequences; sequence ``i`` ends with mark ``i``, smaller than any word."""

    def __init__(self, sequences: np.ndarray, sizes: np.ndarray, length: int):
        """sequences: word hashes, one sequence after another."""
        m = len(sizes)
        _, word = np.unique(sequences, return_inverse=True)
        total = len(sequences) + m
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(total, np.int64)
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        text[~is_end] = word + 1
        self.begin = ends - sizes
        rank = np.where(is_end, 0, text + m - 1)
        rank[ends] = np.arange(m)
        k, half, self_half = 1, None, 1 << (length.bit_length() - 1)
        order = None
        while True:
            if k == self_half:
                half = rank
            after = np.zeros(total, np.int64)
            after[:-k] = rank[k:] + 1
            key = (rank << 32) | after
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.ones(total, bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(new) - 1
            k *= 2
            if new.all() and (half is not None or k > self_half):
                break
            if half is None and k > self_half:
                break
        if half is None:
            half = rank
        # equal first ``length`` words: equal first ``self_half`` words here and at ``length - self_half``
        shift = length - self_half
        tail = np.full(total, -1, np.int64)
        tail[:total - shift] = half[shift:]
        same = (half[order][1:] == half[order][:-1]) & (tail[order][1:] == tail[order][:-1])
        self.less = np.ones(total, np.int64)
        self.less[1:] = ~same
        self.interval = np.cumsum(self.less) - 1
        bwt = text[order - 1]
        bwt[is_end[order - 1]] = 0
        self.matrix = WaveletMatrix(bwt)
        n_symbols = int(text.max(initial=0)) + 1
        counts = np.bincount(text[~is_end], minlength=n_symbols)
        self.first = self.matrix.starts(1 << self.matrix.levels)
        self.c = m + np.cumsum(counts) - counts
        self.text, self.owner_row = text, np.repeat(np.arange(m), sizes + 1)[order]

    def stream(self, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Rows of the first ``windows`` suffixes of each indexed sequence, by backward search from its end mark."""
        m = len(sizes)
        out = np.zeros(int(windows.sum()), np.int64)
        at = np.cumsum(windows) - windows
        row, active = np.arange(m), np.arange(m)
        place = sizes.copy()
        while len(active):
            place[active] -= 1
            symbol = self.text[self.begin[active] + place[active]]
            row[active] = self.c[symbol] + self.matrix.rank(symbol, row[active], self.first)
            inside = active[place[active] < windows[active]]
            out[at[inside] + place[inside]] = row[inside]
            active = active[place[active] > 0]
        return out


def search_words(u: Units, texts: list[bytes], weights: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """One flag per window: its word sequence weighs two or more in this shard."""
    data, offsets = text_bytes(pa.array(texts, pa.binary()))
    words = words_of(data, offsets, whitespace_words())
    sizes = words.counts
    index = FMIndex(words.hash, sizes, u.length)
    rows = index.stream(sizes, windows)
    interval = index.interval[rows]
    weight = np.bincount(interval, np.repeat(weights, windows), int(index.interval[-1]) + 1)
    return weight[interval] >= 2


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 8, shard_units: int = 1 << 20, hot: int = 2000,
                   id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by spaces)."""
    u = Units(_cut_words, length, gram)
    src, spans = repeated_ranges(docs, u, search_words, shard_units, hot, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spans_of = batch.column(2).to_pylist()
            out = []
            for i, j in row_slices(offsets, 1 << 20):
                raw = data[offsets[i]:offsets[j]].tobytes()
                base = offsets[i]
                for r in range(i, j):
                    words = raw[offsets[r] - base:offsets[r + 1] - base].split()
                    gone = covered(len(words), spans_of[r])
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=names)

    return with_spans(src, spans).mapInArrow(run, schema)
