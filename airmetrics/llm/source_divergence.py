"""Operator 12: source divergence audit with a dominance skyband.

For every (lang, source) group of the documents, how its term shares differ from those of the other
sources of its language (part ``pair``: one value a source) and which terms stand out against the
language (part ``term``: the first ``top`` terms). All arithmetic is in whole numbers, so every plan gives the same rows.

* Counting: terms are cut from the UTF-8 bytes in numpy, equal ones found by Arrow's exact dictionary; a slice of
  rows gives one row per (lang, source, term) with occurrences and documents, which Spark adds up. Terms in fewer than
  ``least_docs`` documents of their language go; the rest are the V kept terms.
* A share is p = 1 + floor(10^9 * (count + 1) / (N + V)), N the group's (or language's) count over kept terms;
  the divergence of p from q is floor((p - q)^2 / q). Products are taken as decimals, quotients are exact.
* Terms: the value grows with the group's count and falls with the language's, and ties go to the earlier term. So a
  term is behind every term with no smaller group count, no larger language count and earlier UTF-8, which dominate it.
  Every partition keeps, per group, the terms dominated by fewer than ``top`` others (``Skyband``); these skybands
  are merged by (lang, source, slice of terms) under the same rule, and what is left is ranked exactly. Dominance
  is transitive, so the first ``top`` dominators of a dropped term are themselves in the skyband and no result is lost.
* Pairs: sources are numbered per language and dealt into tiles of ``TILE``; a task takes two tiles and a block
  of terms, streams blocks of about 2,048 terms as dense matrices (a missing count is 0) and adds up both directions
  for all its sources. Work is the size of the answer (sources squared) times the kept terms; memory is one block and one pair of tiles.
  No pair of rows is ever joined.

Defined results: null text, lang and source count as ''; a group without kept terms has value 0 against
every source if its language keeps none, else its flat share; a language with one source has no pairs; documents repeated
with one id count each; doc_id is not used; equal values are ranked by UTF-8 of the item; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.llm.common import stored
from airmetrics.llm.segments import row_slices, text_bytes
from airmetrics.operators.joins import bounded_broadcast

TILE = 128  # sources of a tile
FINE = 2048  # kept terms of one dense block
BUFFER = 1 << 18  # rows held before a skyband is taken
SLICE = 8 << 20  # bytes of text counted at once; a longer text stands alone
_LETTERS = np.zeros(256, np.uint8)  # the byte of a term that a byte stands for; 0 separates
_LETTERS[97:123], _LETTERS[65:91], _LETTERS[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def _slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, occurrences, documents) of the rows ``data[offsets[i]:offsets[i+1]]``, one entry a (group, term)."""
    mapped = _LETTERS[data]
    inside = mapped != 0
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    edge[cuts] |= inside[cuts]
    packed = mapped[inside]
    bounds = np.append(np.flatnonzero(edge[inside]), len(packed)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(packed)).dictionary_encode()
    size = max(len(words.dictionary), 1)
    row = np.searchsorted(offsets, np.flatnonzero(edge), side="right") - 1
    in_row, n = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
    key = group[in_row // size] * size + in_row % size
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    return (words.dictionary.take(pa.array(key[first] % size)), key[first] // size,
            np.add.reduceat(n, first) if len(first) else n, np.diff(np.append(first, len(key))))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); every group also has one row with a null term."""
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            wide = max(len(source.dictionary), 1)
            groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
            name = lambda at: (lang.dictionary.take(pa.array(groups[at] // wide)), source.dictionary.take(pa.array(groups[at] % wide)))
            every = np.arange(len(groups))
            none = pa.array(np.zeros(len(groups), np.int64))
            yield pa.RecordBatch.from_arrays([*name(every), pa.nulls(len(groups), pa.string()), none, none], names)
            for i, j in row_slices(offsets, SLICE):
                terms, at, n, docs_of = _slice_counts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], group[i:j])
                for low in range(0, len(at), 20_000):
                    cut = slice(low, low + 20_000)
                    yield pa.RecordBatch.from_arrays([*name(at[cut]), terms[cut].cast(pa.string()), pa.array(n[cut]), pa.array(docs_of[cut])], names)

    names = ["lang", "source", "term", "n", "docs"]
    counted = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact for any long."""
    top = F.lit(10 ** 9).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", top, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(g: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Mask of points, given in term order, with fewer than ``k`` earlier points of no smaller ``g`` and no larger ``low``."""
    n = len(g)
    keep = np.zeros(n, bool)
    if n <= k:
        return ~keep
    held_g, held_l, m, at, step = np.empty(n, np.int64), np.empty(n, np.int64), 0, 0, 1024
    while at < n:
        part = np.arange(at, min(at + step, n))
        if m >= k:  # per language count: the k-th largest group count held at or below it
            order = np.argsort(held_l[:m], kind="stable")
            heap, kth = [], np.full(m, -1)
            for i, v in enumerate(held_g[order].tolist()):
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, v)
                if len(heap) == k:
                    kth[i] = heap[0]
            place = np.searchsorted(held_l[order], low[part], side="right") - 1
            part = part[g[part] > np.where(place >= 0, kth[place], -1)]
        for low_i in range(0, len(part), 256):
            # earlier points of the chunk count whether held or not: those not held have k held dominators themselves
            c = part[low_i:low_i + 256]
            count = np.count_nonzero((held_g[:m, None] >= g[c]) & (held_l[:m, None] <= low[c]), axis=0)
            count += np.count_nonzero(np.triu((g[c][:, None] >= g[c]) & (low[c][:, None] <= low[c]), 1), axis=0)
            c = c[count < k]
            held_g[m:m + len(c)], held_l[m:m + len(c)], keep[c] = g[c], low[c], True
            m += len(c)
        at += step
        step = min(2 * step, 1 << 16)
    return keep


def _skybands(table: pa.Table, k: int) -> pa.Table:
    """The skyband of every (lang, source) group of the rows."""
    table = table.sort_by([("lang", "ascending"), ("source", "ascending"), ("term", "ascending")]).combine_chunks()
    if not table.num_rows:
        return table
    code = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("lang", "source")]
    cuts = np.flatnonzero((np.diff(code[0]) != 0) | (np.diff(code[1]) != 0)) + 1
    g, low = table.column("n").to_numpy(), table.column("lang_n").to_numpy()
    keep = np.concatenate([skyband(a, b, k) for a, b in zip(np.split(g, cuts), np.split(low, cuts))])
    return table.filter(pa.array(keep))


def partition_skybands(rows: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, lang_n) that are in the skyband of their group within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, limit = None, [], BUFFER
        for b in batches:
            new.append(b)
            if sum(x.num_rows for x in new) >= limit:
                held = _skybands(pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches(new)]), k)
                new, limit = [], max(BUFFER, held.num_rows)
        if new:
            held = _skybands(pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches(new)]), k)
        if held is not None:
            yield from held.to_batches(max_chunksize=10_000)

    return rows.select("lang", "source", "term", "n", "lang_n").mapInArrow(run, "lang string, source string, term string, n long, lang_n long")


def _tile_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums of divergences between the sources of two tiles; rows come sorted by (lang, a, b, block, fine), a
    null term first: such a row carries a source, its share of a missing term and the number of kept terms.
    A tile holds ``width`` sources."""
    names = ["lang", "source", "item", "value"]
    key, sources, index, p0, v, sums, held = None, [], {}, None, 0, None, []

    def flush() -> None:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        term = t.column("term").combine_chunks().dictionary_encode()
        n = len(term.dictionary)
        at = np.array([index[s] for s in t.column("sidx").to_pylist()])
        p = np.repeat(p0[:, None], n, axis=1)
        p[at, term.indices.to_numpy()] = t.column("p").to_numpy()
        flat = base()
        for i in range(len(p)):
            d = p[i][None, :] - p
            sums[i] += (d * d // p).sum(axis=1) - n * flat[i]

    def base() -> np.ndarray:
        d = p0[:, None] - p0[None, :]
        return d * d // p0[None, :]

    def done() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        flush()
        lang, a, b, block = key
        if block == 0:
            sums[...] += v * base()
        tile = np.array([s // width for s in index])
        first, second = (tile == a), (tile == b)
        wanted = (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
        np.fill_diagonal(wanted, False)
        i, j = np.nonzero(wanted)
        for low in range(0, len(i), 10_000):
            x, y = i[low:low + 10_000], j[low:low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array([sources[k] for k in x], pa.string()),
                                              pa.array([sources[k] for k in y], pa.string()), pa.array(sums[x, y])], names)

    fine = None
    for batch in batches:
        cols = [batch.column(c) for c in ("a", "b", "block", "fine")]
        codes = [c.to_numpy() for c in cols] + [batch.column("lang").dictionary_encode().indices.to_numpy(zero_copy_only=False)]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in codes:
            change |= np.diff(c) != 0
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            here = (part.column("lang")[0].as_py(), *(int(c[low]) for c in codes[:3]))
            if here != key:
                yield from done()
                key, sources, index, p0, sums, fine = here, [], {}, np.zeros(0, np.int64), None, None
            if codes[3][low] < 0:  # the sources of the tiles
                for s, i in zip(part.column("source").to_pylist(), part.column("sidx").to_pylist()):
                    index[i] = len(sources)
                    sources.append(s)
                p0 = np.concatenate([p0, part.column("p").to_numpy()])
                v, sums = part.column("v")[0].as_py(), np.zeros((len(sources), len(sources)), np.int64)
                continue
            if codes[3][low] != fine:
                flush()
                fine = codes[3][low]
            held.append(part)
    yield from done()


def pair_values(rows: DataFrame, stats: DataFrame, tile: int = TILE, fine: int = FINE) -> DataFrame:
    """(lang, source, item, value): summed divergence of each source from each other source of its language."""
    tiles = F.expr(f"(n_sources + {tile - 1}) div {tile}")
    shaped = stats.where("n_sources > 1").withColumn("tiles", tiles).withColumn(
        "blocks", F.expr(f"greatest(1, ceil(v / ({2 * fine} * (tiles * (tiles + 1) div 2))))")).withColumn(
        "fines", F.expr(f"greatest(1, ceil(v / ({fine} * blocks)))"))
    deal = lambda df: (df.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
                       .withColumn("tile", F.expr(f"sidx div {tile}")).withColumn("a", F.least("u", "tile")).withColumn("b", F.greatest("u", "tile")))
    keys = ["lang", "a", "b", "block", "fine"]
    heads = deal(shaped).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang", "a", "b", "block", F.lit(-1).cast("long").alias("fine"), F.lit(None).cast("string").alias("term"), "source",
        F.col("sidx").cast("long").alias("sidx"), share(F.lit(0), F.col("n_group"), F.col("v")).alias("p"), "v")
    body = deal(rows.join(bounded_broadcast(shaped), ["lang", "source"])).withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).select(
        "lang", "a", "b", "block", F.pmod(F.xxhash64(F.lit("fine"), "term"), "fines").alias("fine"), "term", "source",
        F.col("sidx").cast("long").alias("sidx"), share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), "v")
    dealt = heads.unionByName(body).repartition("lang", "a", "b", "block").sortWithinPartitions(*keys, "sidx")
    sums = dealt.mapInArrow(lambda batches: _tile_sums(batches, tile), "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(rows: DataFrame, stats: DataFrame, top: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms of each group that stand out against its language."""
    band = partition_skybands(rows, top)
    band = partition_skybands(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(16))), top)
    p, q = (share(F.col(c), F.col(t), F.col("v")) for c, t in (("n", "n_group"), ("lang_n", "n_lang")))
    valued = (band.join(bounded_broadcast(stats.select("lang", "source", "v", "n_group", "n_lang")), ["lang", "source"])
              .withColumn("p", p).withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, tile: int = TILE, fine: int = FINE) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    counts = stored(term_counts(docs), "term-counts")
    kept = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                  .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    rows = stored(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("n_lang"))
    by_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    order = Window.partitionBy("lang")
    stats = stored(counts.select("lang", "source").distinct().join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
                   .na.fill(0, ["v", "n_lang", "n_group"])
                   .withColumn("sidx", F.row_number().over(order.orderBy("source")) - 1).withColumn("n_sources", F.count("*").over(order)), "groups")
    pairs = pair_values(rows, stats, tile, fine).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(term_values(rows, stats, top), "term"))
