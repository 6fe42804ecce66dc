"""Operator 7: n-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (lower-cased words; a text of one to four
words is one shingle, a text without words has none and links with nothing). Two documents
link when the Jaccard similarity of their sets is ``threshold`` (0.8) or more.

* Equal sets are grouped first; a group counts as one set with a weight.
* Sampling shared tokens: for each of ``t`` random orders the set's first shingle is kept (a
  min-hash vector). Taking order ``i`` samples the same shingle from two sets with
  probability equal to their similarity.
* Chosen paths: in each of ``runs`` independent runs a set starts at the root and follows, per
  level, the shingles of ``branch`` sampled orders (chosen by run and path, so sets that went
  the same way choose the same orders). Sets with the same path are in one bucket. Buckets
  of up to ``limit`` sets are compared by brute force; larger ones are split again, down to
  ``levels``, after which what is left still shares that many sampled shingles and is
  compared in blocks. ``runs`` follows from the target recall: a pair at the threshold is missed by one
  path with probability ``1 - threshold``.
* Brute force in a bucket compares min-hash vectors: pairs whose estimate is within four
  standard errors of the threshold join the same candidate group (merge edges, no pair list).
* Candidate groups, merged over all buckets, are verified exactly: every pair of a group is
  compared on whole shingle sets, in blocks of ``block`` sets against ``block`` sets for large
  groups, so no task holds a whole group. A block returns link counts and merge edges only.

Defined results: null or empty text: no links, its own class; repeated rows and ids are each
a row (copies link); ties: a class is named by its smallest id; rows with a null
id are compared and counted like any other, name no class and are always kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import components, stored, text_of
from airmetrics.llm.links import Merger
from airmetrics.llm.segments import gram_hash, mix, plain_words, row_slices, text_bytes, words_of

_SLICE = 1 << 21
_SEED = 80211


def shingle_sets(column: pa.Array, n: int):
    """Yield (first row, shingle hashes (sorted, distinct per row), row offsets)."""
    data, offsets = text_bytes(column)
    for i, j in row_slices(offsets, _SLICE):
        words = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], plain_words())
        counts, h = words.counts, words.hash
        row = np.repeat(np.arange(j - i), counts)
        grams = gram_hash(h, n)
        ok = row[:len(grams)] == row[n - 1:] if len(grams) else np.zeros(0, bool)
        rows, values = [row[:len(grams)][ok]], [grams[ok]]
        for r in np.flatnonzero((counts > 0) & (counts < n)):
            one = h[words.row_first[r]:words.row_first[r + 1]]
            rows.append(np.array([r]))
            values.append(mix(gram_hash(one, len(one)) + np.uint64(len(one))))
        rows, values = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[new], values[new]
        yield i, values, np.searchsorted(rows, np.arange(j - i + 1))


def _min_hashes(values: np.ndarray, cut: np.ndarray, t: int) -> np.ndarray:
    """(rows, t) min-hash vectors of non-empty sets."""
    rng = np.random.default_rng(_SEED)
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.empty((len(cut) - 1, t), np.uint32)
    for j in range(t):
        a, b = rng.integers(0, 2**32, 2, dtype=np.uint64)
        y = (x ^ np.uint32(b)) * np.uint32(a | 1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA6B)
        out[:, j] = np.minimum.reduceat(y, cut[:-1])
    return out


def _signatures(n: int, t: int):
    def run(batches):
        for batch in batches:
            for first, values, cut in shingle_sets(batch.column(2), n):
                size = np.diff(cut)
                some = np.flatnonzero(size)
                sig = np.zeros((0, t), np.uint32)
                lo, hi = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if len(some):
                    sig = _min_hashes(values, np.append(cut[:-1][some], cut[-1]), t)
                    lo[some] = np.add.reduceat(mix(values), cut[:-1][some])
                    hi[some] = np.add.reduceat(mix(values ^ np.uint64(0x5BF03635)), cut[:-1][some])
                sigs: list[bytes | None] = [None] * len(size)
                for i, x in zip(some, sig, strict=True):
                    sigs[i] = x.tobytes()
                part = slice(first, first + len(size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(size), pa.array(lo.view(np.int64)),
                     pa.array(hi.view(np.int64)), pa.array(sigs, pa.binary())], names=["id", "h", "size", "lo", "hi", "sig"])

    return run


def _next_paths(run: np.ndarray, path: np.ndarray, sig: np.ndarray, branch: int) -> np.ndarray:
    """(rows, branch) path hashes one level down: sampled orders depend on run and path only."""
    out = np.empty((len(path), branch), np.uint64)
    for b in range(branch):
        h = mix(path + mix(run.astype(np.uint64) * np.uint64(64) + np.uint64(b + 1)))
        order = (h % np.uint64(sig.shape[1])).astype(np.int64)
        out[:, b] = mix(h ^ mix(sig[np.arange(len(path)), order].astype(np.uint64) + np.uint64(7)))
    return out


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1)


def _start(runs: int, branch: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sig, ids = _matrix(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            for r in range(runs):
                p = _next_paths(np.full(len(ids), r), np.zeros(len(ids), np.uint64), sig, branch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, branch)), pa.array(np.full(len(ids) * branch, r)),
                     pa.array(p.reshape(-1).view(np.int64))], names=["set_id", "run", "path"])

    return run


def _descend(branch: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = _next_paths(r, batch.column(2).to_numpy().view(np.uint64), _matrix(batch.column(3).to_pylist()), branch)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, branch)), pa.array(np.repeat(r, branch)),
                                              pa.array(p.reshape(-1).view(np.int64))], names=["set_id", "run", "path"])

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal min-hashes of every pair."""
    count = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        count += a[:, j][:, None] == b[:, j][None, :]
    return count


def _edges_batch(e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])


def _compare_buckets(need: int):
    """mapInArrow over (path, set_id, sig) sorted by path: merge edges inside each (small) bucket."""

    def compare(ids, sigs):
        state = Merger(ids)
        state.add((_agree(sigs, sigs) >= need) & (ids[:, None] != ids[None, :]), ids)
        return state.edges()

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            path, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = _matrix(batch.column(2).to_pylist())
            cut = np.flatnonzero(path[1:] != path[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                if path[a] != key and held:
                    out.append(compare(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
                    held = []
                key = path[a]
                held.append((ids[a:b], sig[a:b]))
            if sum(e.shape[1] for e in out) > 50_000:
                yield _edges_batch(np.unique(np.concatenate(out, axis=1), axis=1))
                out = []
        if held:
            out.append(compare(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
        if out:
            yield _edges_batch(np.unique(np.concatenate(out, axis=1), axis=1))

    return run


def _candidates(sets: DataFrame, t: int, threshold: float, runs: int, branch: int, limit: int, levels: int) -> DataFrame:
    """Merge edges (a, b) between sets whose estimated similarity may reach the threshold."""
    sigs = sets.select("set_id", "sig")
    rows = stored(sigs.mapInArrow(_start(runs, branch), "set_id long, run long, path long"), "paths-1")
    small, merged = None, None
    for level in range(1, levels + 1):
        size = stored(rows.groupBy("run", "path").agg(F.count("*").alias("n"), F.min("set_id").alias("least")).where("n > 1"),
                      f"path-sizes-{level}")
        found = rows.join(size.where(F.col("n") <= limit), ["run", "path"]).select("set_id", F.xxhash64("run", "path").alias("path"))
        small = found if small is None else small.union(found)
        more = rows.join(size.where(F.col("n") > limit), ["run", "path"])
        if level == levels:
            merged = more.where("set_id <> least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
        else:
            rows = stored(more.select("set_id", "run", "path").join(sigs, "set_id").select("set_id", "run", "path", "sig")
                          .mapInArrow(_descend(branch), "set_id long, run long, path long"), f"paths-{level + 1}")
    need = max(1, ceil(t * (threshold - 4 * sqrt(threshold * (1 - threshold) / t))))
    dealt = small.join(sigs, "set_id").select("path", "set_id", "sig").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(_compare_buckets(need), "a long, b long").union(merged)


def _similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Exact: link[i, j] when |a_i & b_j| / |a_i | b_j| >= threshold, by blocks of the common shingles' columns."""
    both = np.zeros((len(a), len(b)), np.float32)
    left, right = np.concatenate(a), np.concatenate(b)
    left_row = np.repeat(np.arange(len(a)), [len(x) for x in a])
    right_row = np.repeat(np.arange(len(b)), [len(x) for x in b])
    vocabulary = np.intersect1d(left, right)
    if len(vocabulary):
        lc, rc = np.searchsorted(vocabulary, left), np.searchsorted(vocabulary, right)
        lc[lc == len(vocabulary)] = 0
        rc[rc == len(vocabulary)] = 0
        lk, rk = vocabulary[lc] == left, vocabulary[rc] == right
        left_row, lc, right_row, rc = left_row[lk], lc[lk], right_row[rk], rc[rk]
        width = 4096
        for at in range(0, len(vocabulary), width):
            x, y = (lc >= at) & (lc < at + width), (rc >= at) & (rc < at + width)
            n = min(width, len(vocabulary) - at)
            m, k = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
            m[left_row[x], lc[x] - at] = 1
            k[right_row[y], rc[y] - at] = 1
            both += m @ k.T
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    inter = both.astype(np.float64)
    return inter >= threshold * (na[:, None] + nb[None, :] - inter) - 1e-9


def _verify(n: int, threshold: float, block: int):
    """mapInArrow over rows (grp, part, visitor, id, w, text) sorted by the first three: exact links of each part's owners."""

    def run(batches):
        key, held, own, links, state = None, [], None, None, None

        def sets(ids, texts):
            out: list[np.ndarray] = []
            for _, values, cut in shingle_sets(texts, n):
                out += [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return out

        def close():
            e = state.edges()
            some = np.flatnonzero(links)
            a = np.concatenate([state.owners[some], e[0]])
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(np.concatenate([links[some], np.zeros(e.shape[1], np.int64)])),
                 pa.array([None] * len(some) + e[1].tolist(), pa.int64())], names=["a", "n", "b"])

        for batch in batches:
            if not len(batch):
                continue
            grp, part, visitor, ids, w = (batch.column(i).to_numpy() for i in range(5))
            texts = batch.column(5)
            cut = np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                now = (int(grp[a]), int(part[a]))
                if now != key:
                    if state is not None:
                        yield close()
                    key, held, state = now, [], None
                for c in range(a, b, block):
                    d = min(b, c + block)
                    got = sets(ids[c:d], texts.slice(c, d - c))
                    if visitor[a] == 0:
                        held.append((ids[c:d], got))
                        continue
                    if state is None:
                        state = Merger(np.concatenate([h[0] for h in held]))
                        own = [x for h in held for x in h[1]]
                        links = np.zeros(len(own), np.int64)
                    link = _similar(own, got, threshold) & (state.owners[:, None] != ids[c:d][None, :])
                    links += link @ w[c:d]
                    state.add(link, ids[c:d])
        if state is not None:
            yield close()

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, t: int = 128, recall: float = 0.99999,
                 branch: int = 2, limit: int = 64, levels: int = 3, block: int = 256, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_links (other documents linked), class_id, kept (first of its class)."""
    runs = max(1, ceil(log(1 - recall) / log(1 - threshold) / branch))
    text = text_of(docs, text_col)
    src = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = stored(src.mapInArrow(_signatures(n, t), "id long, h long, size long, lo long, hi long, sig binary")
                  .withColumn("set_id", F.when(F.col("size") > 0, F.xxhash64("size", "lo", "hi"))), "signatures")
    sets = stored(rows.where("size > 0").groupBy("set_id").agg(
        F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("least"), F.count("*").alias("w"),
        F.first("sig").alias("sig")), "sets")
    groups = stored(components(_candidates(sets, t, threshold, runs, branch, limit, levels))
                    .join(sets.select("set_id", "rep", "w"), F.col("node") == F.col("set_id"))
                    .select("set_id", "w", "rep", F.col("root").alias("grp")), "candidate-groups")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    reps = groups.join(sizes, "grp").select("grp", "parts", F.col("set_id").alias("set"), "w",
                                            F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h")).hint("shuffle_hash")
    first = (src.join(reps, src["id"].eqNullSafe(reps["rep_id"]) & (src["h"] == reps["rep_h"]))
             .select("grp", "parts", F.col("set").alias("id"), "w", "text").dropDuplicates(["id"]))
    own = first.withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")).withColumn("visitor", F.lit(0))
    visit = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("visitor", F.lit(1))
    cols = ["grp", "part", "visitor", "id", "w", "text"]
    dealt = own.select(cols).unionByName(visit.select(cols)).repartition("grp", "part").sortWithinPartitions("grp", "part", "visitor")
    found = stored(dealt.mapInArrow(_verify(n, threshold, block), "a long, n long, b long"), "set-links")
    per = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("others"))
    root = components(found.where("b is not null").select("a", "b"))
    by_set = stored(sets.select("set_id", "least", "w").join(per, "set_id", "left").join(
        root, F.col("set_id") == F.col("node"), "left").select("set_id", "least", "w", "others", F.coalesce("root", "set_id").alias("class")),
        "set-classes")
    names = by_set.groupBy("class").agg(F.min("least").alias("name"))
    out = rows.select("id", "h", "set_id").join(by_set.join(names, "class"), "set_id", "left")
    zero = F.lit(0).cast("long")
    name = F.coalesce("name", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("h").alias("text_hash"),
                      (F.coalesce("others", zero) + F.coalesce(F.col("w") - 1, zero)).alias("n_links"),
                      name.alias("class_id"), F.coalesce(F.col("id") == name, F.lit(True)).alias("kept"))
