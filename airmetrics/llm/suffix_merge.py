"""Operator 10: byte substring de-duplication by column-wise multi-document suffix sorting.

Texts are UTF-8 bytes. Each byte covered by a ``length``-byte string that also starts anywhere
else (same document included) is removed, judged on the input; matches never cross documents.
``repeats`` deals equal windows to one shard. In a shard the collection's Burrows-Wheeler
transform and common prefixes are built column by column, from the right: every round
prepends one symbol to the suffix of every document that has one left.

* Symbols are runs of ``STEP`` bytes, numbered by the order of their 64-bit digests (any fixed order
  of symbols serves to bring equal strings together). A context of the shard gives ``STEP`` documents, one for
  each phase, so every byte position starts a suffix, and a window is ``length / STEP`` symbols.
* A round reads the last generation's files front to back (suffix order; common prefix of
  neighbours, capped at the window), finds the place of each new suffix ``cX``
  by its first symbol and the place of ``X``, and writes the merged generation to new files.
  The preceding symbol of each row is the transform itself, which the next round prepends.
* Common prefixes change only next to an insertion: the two new neighbours are compared.

After the last round, runs of rows with common prefixes of a whole window are the equal
windows; those that weigh two or more are removed. The files live in the task's own temporary
folder and go with it; a lost task starts its shards afresh.

Defined results: null and empty texts have no bytes; repeated rows are copies of one another;
null ids are kept as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airmetrics.llm.repeats import Digests, Units, covered, repeated_ranges, with_spans
from airmetrics.llm.segments import _BYTE, text_bytes

STEP = 100


def _cut_bytes(data, offsets):
    at = np.arange(len(data))
    return _BYTE[data], offsets, at, at + 1


class Columns:
    """Symbols of the phase documents of some contexts, right-aligned, one row per document; 0 pads the left."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts])
        m = len(texts)
        self.lengths = np.concatenate([(sizes - f) // STEP for f in range(STEP)]).clip(0)
        self.rounds = int(self.lengths.max(initial=0))
        self.documents = len(self.lengths)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(sizes) - sizes
        at = np.arange(max(0, len(data) - STEP + 1))
        _, number = np.unique(Digests(_BYTE[data]).of(at, at + STEP), return_inverse=True)
        self.symbols = np.zeros((self.documents, max(1, self.rounds)), np.int32)
        for back in range(self.rounds):  # the symbol that ends ``back`` symbols before its document's end
            docs = np.flatnonzero(self.lengths > back)
            start = begin[docs % m] + docs // m + STEP * (self.lengths[docs] - 1 - back)
            self.symbols[docs, self.rounds - 1 - back] = number[start] + 1


def common(columns: Columns, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffix pairs (suffix = (depth - 1) * documents + document), at most ``cap`` symbols."""
    n, flat = columns.documents, columns.symbols.reshape(-1)
    (depth_a, doc_a), (depth_b, doc_b) = np.divmod(a, n), np.divmod(b, n)
    limit = np.minimum(np.minimum(depth_a, depth_b) + 1, cap)
    at_a = (doc_a + 1) * columns.symbols.shape[1] - (depth_a + 1)
    at_b = (doc_b + 1) * columns.symbols.shape[1] - (depth_b + 1)
    out = np.zeros(len(a), np.int64)
    left = np.flatnonzero(limit > 0)
    step = 0
    while len(left):  # most pairs part at their first symbol
        left = left[flat[at_a[left] + step] == flat[at_b[left] + step]]
        step += 1
        out[left] = step
        left = left[limit[left] > step]
    return out


def _spots(order: np.ndarray, place: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each new suffix, the number of rows before it: binary search for the place of what follows its first
    symbol among the rows ``lo`` to ``hi`` that begin with that symbol."""
    lo, hi = lo.copy(), hi.copy()
    left = np.flatnonzero(lo < hi)
    while len(left):
        mid = (lo[left] + hi[left]) >> 1
        row = order[mid]
        less = np.where(row < n, row, place[np.maximum(row - n, 0)] + n) < rest[left]
        lo[left[less]] = mid[less] + 1
        hi[left[~less]] = mid[~less]
        left = left[lo[left] < hi[left]]
    return lo


def build(columns: Columns, cap: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in sorted order, common prefix with the row before, capped) after all rounds."""
    n = columns.documents
    place = np.zeros(n * max(1, columns.rounds), np.int32)  # place of each suffix; end marks come before all
    order_file, prefix_file = os.path.join(folder, "order-0"), os.path.join(folder, "prefix-0")
    np.zeros(0, np.int32).tofile(order_file)
    np.zeros(0, np.uint8).tofile(prefix_file)
    flat = columns.symbols
    begins = np.zeros(int(flat.max(initial=0)) + 2, np.int64)  # [c + 1]: rows that begin with symbol c
    for depth in range(1, columns.rounds + 1):
        docs = np.flatnonzero(columns.lengths >= depth)
        order = np.fromfile(order_file, np.int32)
        prefix = np.fromfile(prefix_file, np.uint8)
        symbol = flat[docs, columns.rounds - depth].astype(np.int64)
        rest = docs if depth == 1 else place[(depth - 2) * n + docs].astype(np.int64) + n
        by = np.argsort((symbol << 32) | rest)
        symbol, rest, new = symbol[by], rest[by], ((depth - 1) * n + docs[by]).astype(np.int32)
        upto = np.cumsum(begins)
        spot = _spots(order, place, n, upto[symbol], upto[symbol + 1], rest)
        at = spot + np.arange(len(new))
        begins += np.bincount(symbol + 1, minlength=len(begins))
        merged = np.empty(len(order) + len(new), np.int32)
        is_new = np.zeros(len(merged) + 1, bool)
        is_new[at] = True
        old = ~is_new[:-1]
        merged[at], merged[old] = new, order
        joined = np.zeros(len(merged), np.uint8)
        joined[old] = prefix
        is_new[1:] |= is_new[:-1]  # a new row and the row behind it
        is_new[0] = False
        check = np.flatnonzero(is_new[:-1])
        joined[check] = common(columns, merged[check - 1].astype(np.int64), merged[check].astype(np.int64), cap)
        joined[:1] = 0
        place[merged] = np.arange(len(merged), dtype=np.int32)
        for done in (order_file, prefix_file):
            os.remove(done)
        order_file, prefix_file = os.path.join(folder, f"order-{depth}"), os.path.join(folder, f"prefix-{depth}")
        merged.tofile(order_file)
        joined.tofile(prefix_file)
    return np.fromfile(order_file, np.int32), np.fromfile(prefix_file, np.uint8)


def search_bytes(u: Units, texts: list[bytes], weights: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """One flag per window: its bytes weigh two or more in this shard."""
    columns = Columns(texts)
    symbols = u.length // STEP
    with tempfile.TemporaryDirectory() as folder:
        order, prefix = build(columns, symbols, folder)
    n, m = columns.documents, len(texts)
    group = np.cumsum(prefix < symbols)
    order = order.astype(np.int64)
    doc, depth = order % n, order // n + 1
    ctx, phase = doc % m, doc // m
    start = phase + STEP * (columns.lengths[doc] - depth)  # byte in the context where the suffix starts
    window = start < windows[ctx]
    weight = np.bincount(group[window], weights[ctx[window]], int(group[-1]) + 1 if len(group) else 1)
    out = np.zeros(int(windows.sum()), bool)
    base = np.cumsum(windows) - windows
    out[base[ctx[window]] + start[window]] = weight[group[window]] >= 2
    return out


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 128, shard_units: int = 1 << 18, hot: int = 2000,
                   id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    if length % STEP:
        raise ValueError(f"length must be a multiple of {STEP}")
    u = Units(_cut_bytes, length, gram)
    src, spans = repeated_ranges(docs, u, search_bytes, shard_units, hot, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for r, s in enumerate(batch.column(2).to_pylist()):
                part = data[offsets[r]:offsets[r + 1]]
                if s:
                    gone = covered(len(part), s)
                    kept, removed = part[~gone].tobytes(), int(gone.sum())
                    n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                else:
                    kept, removed, n_spans = part.tobytes(), 0, 0
                out.append((len(part), removed, n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=names)

    return with_spans(src, spans).mapInArrow(run, schema)
