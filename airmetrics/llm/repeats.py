"""Shared frame of the two substring operators: which windows of fixed length occur twice.

Units are words or bytes; a window is ``length`` consecutive units of one document. Every
window has an anchor: its smallest hashed run of ``gram`` units (the leftmost of equal
ones). Equal windows have equal anchors at equal places, so windows only have to be
compared with windows of the same anchor. Consecutive windows with one anchor occurrence
form a context: (document, first window, number of windows).

1. ``contexts``: one pass over all texts lists every context with its anchor and a digest of
   its units. No text leaves this step; anchors that occur once in all are dropped.
2. Equal contexts (same anchor and digest) are counted with map-side partial aggregation; one
   of them stands for all, with their number as its weight.
3. ``representatives``: the chosen contexts are cut out of the texts and dealt to shards by
   anchor, so all windows that can be equal meet in one shard. An anchor with more than
   ``hot`` different contexts (a passage that very many documents share) is split: its contexts
   are cut into single windows, each dealt by its own hash, equal ones added up before the shuffle.
4. The operator's index searches each shard and returns which windows of each context weigh
   two or more.
5. ``ranges``: the answers go to all copies of a context by (anchor, digest), then to their
   documents as unit ranges.

All joins are equi-joins whose hot keys adaptive execution can split; nothing is collected or
broadcast. A document is known by its id and a hash of its text, so repeated ids are told apart and
repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import stored, text_of
from airmetrics.llm.segments import mix, row_slices, sliding_min, text_bytes

_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Units:
    """How rows are cut: ``cut(data, offsets)`` -> (unit hashes, first unit of each row, unit start and end bytes)."""

    cut: Callable
    length: int
    gram: int
    slice_bytes: int = 1 << 17


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse modulo 2**64; kept while they are slice-sized."""
    have = _KEPT.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 17)
        have = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 22:
            _KEPT[base] = have
    return have[0][:n], have[1][:n]


_KEPT: dict[int, tuple] = {}


class Digests:
    """Hashes of any run of units, from prefix sums of a polynomial."""

    def __init__(self, h: np.ndarray, base: int = _BASE):
        power, self._back = _powers(base, len(h) + 1)
        self._sum = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._back[start])


def _contexts_of(h: np.ndarray, row_first: np.ndarray, u: Units):
    """(row, first window in the slice, windows, anchor hash, digest) of a run of rows."""
    n = len(h) - u.length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    row = np.repeat(np.arange(len(row_first) - 1), np.diff(row_first))
    digests = Digests(h)
    at = np.arange(len(h) - u.gram + 1)
    grams = digests.of(at, at + u.gram)
    bits = np.uint64(max(22, len(grams).bit_length()))
    keyed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # equal values: the leftmost
    place = (sliding_min(keyed, u.length - u.gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    window = np.flatnonzero(row[:n] == row[u.length - 1:])
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = place[window]
    new = np.ones(len(window), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(window)))
    start, anchor = window[at], place[at]
    digest = digests.of(start, start + size + u.length - 1)
    digest = mix(digest + (anchor - start).astype(np.uint64) * np.uint64(_BASE2) + size.astype(np.uint64))
    return row[start], start, size, grams[anchor], digest


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def contexts(src: DataFrame, u: Units) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in row_slices(offsets, u.slice_bytes):
                h, first, _, _ = u.cut(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                row, start, size, anchor, digest = _contexts_of(h, first, u)
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((start - first[row]).astype(np.int64)),
                     pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))],
                    names=["id", "th", "a", "n", "anchor", "ctx"])

    return src.mapInArrow(run, "id long, th long, a long, n int, anchor long, ctx long")


_ENTRY = "hot boolean, anchor long, ctx long, i int, shard long, key long, w long, n int, text binary"


def _cut_out(u: Units):
    """mapInArrow function: (text, wanted contexts) -> entries; a hot context gives one entry per window."""

    def run(batches):
        names = [x.split()[0] for x in _ENTRY.split(", ")]
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            wanted = batch.column(1)
            flat = wanted.flatten()
            f = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "ctx", "a", "n", "w", "hot")}
            per = np.diff(wanted.offsets.to_numpy())
            ends = np.cumsum(per)
            for i, j in row_slices(offsets, u.slice_bytes):
                part = data[offsets[i]:offsets[j]]
                h, first, begin, end = u.cut(part, offsets[i:j + 1] - offsets[i])
                sel = slice(int(ends[i] - per[i]), int(ends[j - 1]))
                owner = np.repeat(np.arange(j - i), per[i:j])
                a = f["a"][sel] + first[owner]
                n, hot = f["n"][sel].astype(np.int64), f["hot"][sel].astype(bool)
                if not len(a):
                    continue
                times = np.where(hot, n, 1)
                src = np.repeat(np.arange(len(a)), times)
                k = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
                start, size = a[src] + k, np.where(hot, 1, n)[src]
                stop = start + size + u.length - 1
                one, two = Digests(h, _BASE).of(start, stop), Digests(h, _BASE2).of(start, stop)
                anchor, ctx, is_hot = f["anchor"][sel][src], f["ctx"][sel][src], hot[src]
                raw = part.tobytes()
                text = [raw[x:y] for x, y in zip(begin[start].tolist(), end[stop - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(is_hot), pa.array(anchor), pa.array(ctx), pa.array(k.astype(np.int32)),
                     pa.array(np.where(is_hot, one.view(np.int64), anchor)), pa.array(np.where(is_hot, two.view(np.int64), ctx)),
                     pa.array(f["w"][sel][src]), pa.array(size.astype(np.int32)), pa.array(text, pa.binary())], names=names)

    return run


def _sharded(search: Callable, u: Units, shard_units: int):
    """mapInArrow function over (shard, key, w, n, text) sorted by shard and key: runs of whole shard keys of about
    ``shard_units`` units go to ``search(units, text bytes, weights, windows)`` -> one flag per window, context after context."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def done():
            shard, key, w, n, text = (np.concatenate([x[i] for x in held]) if i < 4 else [t for x in held for t in x[4]]
                                      for i in range(5))
            new = np.ones(len(key), bool)  # a row that is in the table twice sent its contexts twice
            new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
            at = np.flatnonzero(new)
            shard, key, w, n, text = shard[at], key[at], w[at], n[at].astype(np.int64), [text[i] for i in at]
            flag = search(u, text, w, n)
            owner = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(flag)) - np.repeat(np.cumsum(n) - n, n)
            left = flag.copy()
            left[1:] &= ~(flag[:-1] & (owner[1:] == owner[:-1]))
            right = flag.copy()
            right[:-1] &= ~(flag[1:] & (owner[1:] == owner[:-1]))
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[owner[a]]), pa.array(key[owner[a]]), pa.array(inside[a].astype(np.int32)),
                 pa.array((inside[b] + 1).astype(np.int32))], names=["shard", "key", "lo", "hi"])

        for batch in batches:
            if not len(batch):
                continue
            shard, key, w = (batch.column(i).to_numpy() for i in range(3))
            n, text = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            cut = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(text)], strict=True):
                if size >= shard_units and shard[a] != last:
                    yield done()
                    held, size = [], 0
                held.append((shard[a:b], key[a:b], w[a:b], n[a:b], text[a:b]))
                size += int(n[a:b].sum()) + (u.length - 1) * int(b - a)
                last = shard[b - 1]
        if held:
            yield done()

    return run


def repeated_ranges(docs: DataFrame, u: Units, search: Callable, shard_units: int, hot: int = 2000,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(source rows (id, th, text), ranges (id, th, spans: array of unit start and end)) of all repeated windows."""
    src = _source(docs, id_col, text_col)
    every = stored(contexts(src, u), "contexts")
    shared = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    every = stored(every.join(shared, "anchor"), "shared-contexts")
    distinct = every.groupBy("anchor", "ctx").agg(F.count("*").alias("w"), *[F.first(c).alias(c) for c in ("id", "th", "a", "n")])
    distinct = stored(distinct, "distinct-contexts")
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("anchor", F.lit(True).alias("hot"))
    crowded = stored(crowded, "crowded-anchors")
    wanted = (distinct.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
              .groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "ctx", "a", "n", "w", "hot")).alias("wanted"))
              .withColumnsRenamed({"id": "r_id", "th": "r_th"}).hint("shuffle_hash"))
    cut = (src.join(wanted, src["id"].eqNullSafe(F.col("r_id")) & (src["th"] == F.col("r_th")))
           .select("text", "wanted").mapInArrow(_cut_out(u), _ENTRY))
    some_hot = bool(crowded.take(1))
    cols = ["shard", "key", "w", "n", "text"]
    if some_hot:
        cut = stored(cut, "cut-contexts")
        # the same window of one context is one entry; equal windows of several contexts add up
        single = cut.where("hot").groupBy("shard", "key").agg(F.sum("w").alias("w"), F.first("n").alias("n"), F.first("text").alias("text"))
        entries = cut.where("not hot").select(cols).unionByName(single)
    else:
        entries = cut.select(cols)
    found = (entries.repartition("shard").sortWithinPartitions("shard", "key")
             .mapInArrow(_sharded(search, u, shard_units), "shard long, key long, lo int, hi int"))
    if some_hot:
        found = stored(found, "found")
        windows = cut.where("hot").select("anchor", "ctx", "i", "shard", "key").distinct()
        split = windows.join(found, ["shard", "key"]).select("anchor", "ctx", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))
        whole = found.withColumnsRenamed({"shard": "anchor", "key": "ctx"}).select("anchor", "ctx", "lo", "hi")
        found = whole.unionByName(split)
    else:
        found = found.withColumnsRenamed({"shard": "anchor", "key": "ctx"})
    spans = (every.select("id", "th", "a", "anchor", "ctx").join(found, ["anchor", "ctx"])
             .select("id", "th", (F.col("a") + F.col("lo")).alias("s"), (F.col("a") + F.col("hi") + (u.length - 1)).alias("e"))
             .groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    return src, stored(spans, "spans")


def with_spans(src: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of every source row."""
    spans = spans.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), "spans").hint("shuffle_hash")
    return src.join(spans, src["id"].eqNullSafe(F.col("r_id")) & (src["th"] == F.col("r_th")), "left").select("id", "text", "spans")


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    mark = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(mark, [s["s"] for s in spans], 1)
        np.add.at(mark, [s["e"] for s in spans], -1)
    return np.cumsum(mark[:-1]) > 0
