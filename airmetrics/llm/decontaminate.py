"""Operator 6: benchmark decontamination by a prefix-filtered set join.

Words are runs of digits, lower-cased letters and characters beyond ASCII. The sets to join
are the item windows (``window`` consecutive words of an item; an item of fewer words, but
not none, is one window) and the documents' word positions.

* Order: every window has its positional shingles (runs of up to three words). How often each
  of them occurs in all documents is counted (one aggregation over the whole corpus), and a
  window's shingles are ordered by that count, rarest first.
* Prefix: containment must be whole, so the necessary prefix of a window is its rarest
  shingle alone. Document positions that hold a prefix shingle are the only candidates.
* Bounds: the shingle's place in the window fixes the start of the occurrence, which must
  lie in the document (position bound) and leave room for the window's words (length bound).
* Verify: all words of the window are compared at that place; a hit window marks its words.

Documents are read where they are (no shuffle of text). Items are cut into windows on Spark, the
distinct windows are dealt by hash to blocks of about ``block_windows`` and written. The driver
reads one block at a time and broadcasts it on its own; a document's word hits are carried from
block to block as a bit set, and written after every ``_CHAIN`` blocks, whose broadcasts then go.

Defined results: null texts have no words; a null item id is listed as "null"; repeated
items and documents are each judged (an item id counts once per document); empty tables
give no rows, or no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import stored, text_of
from airmetrics.llm.segments import gram_hash, mix, plain_words, row_slices, text_bytes, words_of

_SLICE = 1 << 21
_CHAIN = 8


def _columns(batch: pa.RecordBatch, names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=names)


class _HashSet:
    """Sorted 64-bit values with a bit table in front: most lookups end at one byte."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self._seen = np.zeros(1 << 20, bool)
        self._seen[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def positions(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes into h, indexes into values) of the members."""
        at = np.flatnonzero(self._seen[(h >> np.uint64(44)).view(np.int64)])
        if len(at) == 0 or len(self.values) == 0:
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[where] == h[at]
        return at[ok], where[ok]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    return gram_hash(h, k) if k > 1 else mix(h)


def item_windows(items: list[tuple[str | None, str | None]], window: int) -> dict[tuple[int, ...], set[str]]:
    """Distinct windows (word hashes) of the items, with the ids that hold them."""
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    words = words_of(data, offsets, plain_words())
    out: dict[tuple[int, ...], set[str]] = {}
    for (item, _), a, b in zip(items, words.row_first[:-1], words.row_first[1:], strict=True):
        h = words.hash[a:b].tolist()
        for i in range(max(1, len(h) - window + 1) if h else 0):
            out.setdefault(tuple(h[i:i + window]), set()).add("null" if item is None else str(item))
    return out


def _window_blocks(items: DataFrame, window: int, block_windows: int) -> tuple[DataFrame, int]:
    """Written rows (block, words, ids), a row for each distinct window of the items (i, t), and the number of blocks."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = item_windows(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), window)
                rows = [(w, i) for w, ids in found.items() for i in ids]
                words = [np.array(w, np.uint64).view(np.int64) for w, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.list_(pa.int64())), pa.array([i for _, i in rows], pa.string())], names=["words", "id"])

    windows = stored(items.where("t is not null").mapInArrow(run, "words array<long>, id string")
                     .groupBy("words").agg(F.collect_set("id").alias("ids")), "benchmark-windows")
    n = max(1, -(-windows.count() // block_windows))
    if n == 1:
        return windows.withColumn("block", F.lit(0)), n
    return stored(windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n)).cast("int")).orderBy("block"), "window-blocks"), n


def _shingles(windows: list[tuple[int, ...]], size: int) -> list[tuple[int, np.ndarray]]:
    """For each window: shingle length and its positional shingle hashes."""
    return [(k := min(size, len(w)), _grams(np.array(w, np.uint64), k)) for w in windows]


def corpus_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Occurrences in all documents of the given shingles (by length); the answer has at most that many rows."""
    sets = {k: _HashSet(v) for k, v in shingles.items()}

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            total = {k: np.zeros(len(s.values), np.int64) for k, s in sets.items()}
            for i, j in row_slices(offsets, _SLICE):
                words = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], plain_words())
                row = np.repeat(np.arange(j - i), words.counts)
                for k, s in sets.items():
                    at, which = s.positions(_grams(words.hash, k))
                    ok = row[at] == row[at + k - 1]
                    total[k] += np.bincount(which[ok], minlength=len(s.values))
            for k, s in sets.items():
                some = np.flatnonzero(total[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, np.int32)), pa.array(s.values[some].view(np.int64)),
                     pa.array(total[k][some])], names=["k", "h", "n"])

    rows = (docs.mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect())
    return {(r["k"], r["h"] & (2**64 - 1)): r["n"] for r in rows}


class _Matcher:
    """One block of windows, ready to be searched in runs of documents."""

    def __init__(self, windows: dict[tuple[int, ...], set[str]], counts: dict[tuple[int, int], int], shingle: int):
        keys = list(windows)
        self.items = [sorted(windows[w]) for w in keys]
        self.words = [np.array(w, np.uint64) for w in keys]
        entry: dict[int, list[tuple[int, int, int]]] = {}
        for n, (k, grams) in enumerate(_shingles(keys, shingle)):
            best = min(range(len(grams)), key=lambda p: (counts.get((k, int(grams[p])), 0), p))
            entry.setdefault(k, []).append((int(grams[best]), n, best))
        self.tables = {}
        for k, rows in entry.items():
            rows.sort()
            prefix = np.array([r[0] for r in rows], np.uint64)
            members = _HashSet(prefix)
            first = np.searchsorted(prefix, members.values)
            self.tables[k] = (members, first, np.append(first[1:], len(prefix)),
                              np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.sizes = np.array([len(w) for w in self.words], np.int64)

    def hits(self, h: np.ndarray, row: np.ndarray, row_first: np.ndarray, row_end: np.ndarray):
        """(window number, first word) of every occurrence."""
        found = []
        for k, (members, first, last, number, place) in self.tables.items():
            at, which = members.positions(_grams(h, k))
            if not len(at):
                continue
            n = last[which] - first[which]
            entry = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = np.repeat(at, n)
            win, start = number[entry], at - place[entry]
            own = row[at]
            ok = (start >= row_first[own]) & (start + self.sizes[win] <= row_end[own])
            win, start = win[ok], start[ok]
            for size in np.unique(self.sizes[win]):
                of = np.flatnonzero(self.sizes[win] == size)
                used, back = np.unique(win[of], return_inverse=True)
                table = np.stack([self.words[w] for w in used])
                same = np.ones(len(of), bool)
                for p in range(size):
                    left = np.flatnonzero(same)
                    if not len(left):
                        break
                    same[left] = h[start[of[left]] + p] == table[back[left], p]
                found.append(np.stack([win[of[same]], start[of[same]]]))
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _search(matcher: _Matcher, final: bool):
    """mapInArrow function: (id, text[, bits, items]) -> the same with the block's hits, or counts when final."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            old_bits, old_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, n_hit, bits, items = [], [], [], []
            for i, j in row_slices(offsets, _SLICE):
                words = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], plain_words())
                h, first = words.hash, words.row_first
                row = np.repeat(np.arange(j - i), words.counts)
                win, start = matcher.hits(h, row, first[:-1], first[1:])
                mark = np.zeros(len(h) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + matcher.sizes[win], -1)
                hit = np.cumsum(mark[:-1]) > 0
                own: dict[int, set[str]] = {}
                for r, w in set(zip(row[start].tolist(), win.tolist(), strict=True)):
                    own.setdefault(r, set()).update(matcher.items[w])
                for r in range(j - i):
                    mine = hit[first[r]:first[r + 1]]
                    if old_bits[i + r]:
                        mine = mine | np.unpackbits(np.frombuffer(old_bits[i + r], np.uint8), count=len(mine)).astype(bool)
                    n_words.append(len(mine))
                    n_hit.append(int(mine.sum()))
                    bits.append(np.packbits(mine).tobytes() if not final and mine.any() else None)
                    items.append(sorted(own.get(r, set()) | set(old_items[i + r] or ())))
            if not final:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    names=["row", "text", "bits", "items"])
                continue
            n_hit_a, n_words_a = np.array(n_hit, np.int64), np.array(n_words, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words_a), pa.array(n_hit_a), pa.array(items, pa.list_(pa.string())),
                 pa.array((n_hit_a > 0) & (20 * n_hit_a >= n_words_a))],
                names=["row", "n_words", "n_hit", "items", "contaminated"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3,
                  block_windows: int = 200_000, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), n_words, n_hit, items, contaminated."""
    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

    texts = docs.select(text_of(docs, text_col).alias("text"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[item_text_col].cast("string").alias("t"))
    windows, n_blocks = _window_blocks(items, window, block_windows)
    sc = docs.sparkSession.sparkContext
    row_type = StructType([StructField("row", docs.schema, False)])
    state = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs, text_col).alias("text"),
                        F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("items"))
    mid = StructType([*row_type.fields, *state.schema.fields[1:]])
    end = StructType([*row_type.fields, StructField("n_words", LongType()), StructField("n_hit", LongType()),
                      StructField("items", ArrayType(StringType())), StructField("contaminated", BooleanType())])
    chain = []
    for n in range(n_blocks):
        block = {tuple(x & (2**64 - 1) for x in r["words"]): set(r["ids"]) for r in windows.where(F.col("block") == n).collect()}
        wanted: dict[int, list[np.ndarray]] = {}
        for k, grams in _shingles(list(block), shingle):
            wanted.setdefault(k, []).append(grams)
        counts = corpus_counts(texts, {k: np.concatenate(v) for k, v in wanted.items()}) if block else {}
        matcher = sc.broadcast(_Matcher(block, counts, shingle))
        last = n == n_blocks - 1
        state = state.mapInArrow(_lazy(matcher, last), end if last else mid)
        chain.append(matcher)
        if len(chain) == _CHAIN and not last:
            state = stored(state, "contamination")
            for m in chain:
                m.destroy()
            chain = []
    return state


def _lazy(matcher, final: bool):
    return lambda batches: _search(matcher.value, final)(batches)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(F.col("row")[id_col].alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")
