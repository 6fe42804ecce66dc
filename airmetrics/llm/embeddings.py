"""Operator 3: embedding near-duplicates by collision counting on one-dimensional projections.

Vectors are scaled to length 1 and projected on many random directions. For a pair at
cosine ``c`` the difference of a projection is normal with variance ``2 - 2c``, so the
chance ``p`` that one falls into the other's window (query-centred, half width ``window``)
is known, and the number of collisions over ``m`` projections is Binomial(m, p). The count
a pair must reach is the largest with which a pair at exactly the threshold still passes
with probability ``recall`` (cells and both counts together); closer pairs pass more often. Pairs that pass are verified by
their cosine in double precision.

* Equal vectors are grouped first (one hash aggregation); a group counts as one vector with
  a weight, so copies are never expanded into pairs.
* Spread: the first ``depth`` projections are cut at their medians. A vector is owned by the
  cell of its signs and also visits every cell that differs only in projections where it
  lies within ``cell_window`` of the cut (a query-centred window again). A pair is admitted
  when either one lies in the window of every cut that separates them. If both do, each counts
  the link where it is owner; if only one does, the two meet once and both count it there, so
  link counts need no pair list. ``depth`` grows with the logarithm of the number of vectors, and
  the window is widened with it (``cell_window_for``) so that the cells lose no more than a third of what
  ``recall`` lets be missed. Owners of a cell are dealt to blocks of at most
  about ``block_rows`` (a hot cell has more blocks), and visitors pass a block in sorted runs.
* In a block the collisions of a few projections are counted first, the rest only for pairs that
  can still reach the count.

What leaves a block is one row per owner (its number of links) and merge edges, never pairs.
Components come from ``common.components``.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components link with nothing, not even with each other; vectors of another length than the
most common one are compared among their own length; rows sharing a ``vec_id`` are each a row
of the result, their vectors are all nodes of that id; a null id links with nothing;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import components, stored
from airmetrics.llm.links import Merger

_SEED = 4711


def required_count(m: int, p: float, recall: float) -> int:
    """Largest count that Binomial(m, p) reaches with probability ``recall`` at least."""
    below = 0.0
    for k in range(m + 1):
        below += comb(m, k) * p**k * (1 - p) ** (m - k)
        if 1 - below < recall:
            return k
    return m


def cell_miss(threshold: float, depth: int, cell_window: float) -> float:
    """Chance that ``depth`` cuts keep a pair at cosine ``threshold`` apart: neither lies in the window of all cuts that separate them.

    Distances to a cut are normal with variance ``s2`` for each of the pair and ``2 - 2 * threshold`` for their difference. How
    close the table lies around its centre sets ``s2``; the worst is taken.
    """
    if threshold >= 1 or depth == 0:
        return 0.0
    far = np.linspace(cell_window, cell_window + 8, 1601)
    step, worst = far[1] - far[0], 0.0
    tail = np.vectorize(lambda x: (1 - erf(x / sqrt(2))) / 2)
    for s2 in np.linspace((1 - threshold) / 2, 1, 24)[1:]:
        rho = 1 - (1 - threshold) / s2
        spread = sqrt(s2 * (1 - rho * rho))
        density = 2 * np.exp(-far * far / (2 * s2)) / sqrt(2 * np.pi * s2) * step
        density[[0, -1]] /= 2
        one = float(density @ tail(rho * far / spread))  # this one outside the window, the other behind the cut
        both = float(density @ tail((cell_window + rho * far) / spread))  # and that one outside as well
        worst = max(worst, 1 - 2 * (1 - one) ** depth + (1 - 2 * one + both) ** depth)
    return worst


def cell_window_for(threshold: float, depth: int, miss: float, least: float) -> float:
    """Smallest window from ``least`` up (by 0.02) with which the cells lose at most ``miss`` of the pairs at the threshold."""
    out = least
    while cell_miss(threshold, depth, out) > miss:
        out += 0.02
    return out


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim]).standard_normal((dim, m))


def _units(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


_GRID = 0.04


def _coarse(proj: np.ndarray) -> np.ndarray:
    """Projections on a byte grid, one row per projection. Collisions are counted on the grid with a window that is
    wider by a cell, so none is lost; beyond the grid's ends values are held at them."""
    return np.ascontiguousarray(np.clip(np.round(proj / _GRID) + 128, 0, 255).astype(np.uint8).T)


class _Block:
    """Owners of one block; visitors stream by."""

    def __init__(self, ids, reps, weights, vectors, window: float, early: int, m: int, recall: float, threshold: float,
                 depth: int):
        u = _units(vectors)
        proj = u @ directions(u.shape[1], depth + m)[:, depth:]
        order = np.argsort(proj[:, 0], kind="stable")
        self.ids, self.weights, self.codes = ids[order], weights[order], reps[order]
        self.u, self.proj = u[order], proj[order].astype(np.float32)
        self.coarse, self.reach = _coarse(self.proj), int(np.ceil(window / _GRID)) + 1
        self.links = np.zeros(len(ids), np.int64)
        self.merger = Merger(self.ids)
        p = erf(window / sqrt(2 * (2 - 2 * threshold))) if threshold < 1 else 1.0
        self.window, self.early, self.threshold = np.float32(window), early, threshold
        share = 1 - (1 - recall) / 3  # what may be missed is split between the cells, the early and the whole count
        self.need_early, self.need = required_count(early, p, share), required_count(m, p, share)

    def meet(self, ids, codes, weights, vectors, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts the owners' links; returns (visitor, links) of those that the visitors' own cells do not see."""
        u = _units(vectors)
        proj = (u @ directions(u.shape[1], depth + self.proj.shape[1])[:, depth:]).astype(np.float32)
        order = np.argsort(proj[:, 0], kind="stable")
        runs = [order[at:at + 256] for at in range(0, len(order), 256)]
        seen = [self._run(ids[o], codes[o], weights[o], u[o], proj[o]) for o in runs]
        return [x for x in seen if x is not None]

    def _run(self, ids, codes, weights, u, proj):
        # all owners are counted; the sorted first projection tells which can collide on it
        coarse = _coarse(proj)
        rows, cols = self._pass(proj, coarse)
        if not len(rows):
            return None
        o, v = np.unique(rows), np.unique(cols)
        dense = np.zeros((len(o), len(v)), bool)
        dense[np.searchsorted(o, rows), np.searchsorted(v, cols)] = True
        if dense.mean() > 0.05:
            dense &= self._count(self.coarse[:, o], coarse[:, v], range(proj.shape[1])) >= self.need
            r, c = np.nonzero(dense) if dense.any() else (np.zeros(0, np.int64),) * 2
            if not len(r):
                return None
            link = dense & ((self.u[o] @ u[v].T) >= self.threshold)
        else:
            count = (np.abs(self.proj[rows] - proj[cols]) <= self.window).sum(axis=1)
            keep = count >= self.need
            rows, cols = rows[keep], cols[keep]
            good = np.einsum("ij,ij->i", self.u[rows], u[cols]) >= self.threshold
            link = np.zeros(dense.shape, bool)
            link[np.searchsorted(o, rows[good]), np.searchsorted(v, cols[good])] = True
        link &= self.ids[o][:, None] != ids[v][None, :]
        if not link.any():
            return None
        self.links[o] += link @ weights[v]
        self.merger.add(link if len(o) == len(self.ids) else self._wide(link, o), ids[v])
        # the visitor came through all cuts between the two; where the owner cannot go the other way, both count here
        other = self.codes[o, 0][:, None] ^ codes[v, 0][None, :]
        once = link & ((other & ~self.codes[o, 1][:, None]) != 0)
        met = np.flatnonzero(once.any(axis=0))
        return (ids[v[met]], once[:, met].T @ self.weights[o]) if len(met) else None

    def _wide(self, link: np.ndarray, o: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), link.shape[1]), bool)
        out[o] = link
        return out

    def _count(self, mine: np.ndarray, theirs: np.ndarray, which: range) -> np.ndarray:
        """Window collisions of every pair over some projections (byte arithmetic, wrapping)."""
        count = np.zeros((mine.shape[1], theirs.shape[1]), np.uint8)
        reach, gap = np.uint8(self.reach), np.uint8(2 * self.reach)
        space, hit = np.empty(count.shape, np.uint8), np.empty(count.shape, bool)
        for j in which:
            np.subtract((mine[j] + reach)[:, None], theirs[j][None, :], out=space)
            np.less_equal(space, gap, out=hit)
            count += hit.view(np.uint8)
        return count

    def _pass(self, proj, coarse):
        """Pairs that reach the early count. Owners and visitors are sorted by the first projection, and the whole
        run can only collide there with the owners inside its outermost windows."""
        low = np.searchsorted(self.proj[:, 0], proj[0, 0] - self.window, side="left")
        high = np.searchsorted(self.proj[:, 0], proj[-1, 0] + self.window, side="right")
        if self.need_early < self.early or low >= high:  # a pair may miss the first window and still reach the count
            low, high = 0, len(self.ids)
        rows, cols = np.nonzero(self._count(self.coarse[:, low:high], coarse, range(self.early)) >= self.need_early)
        return rows + low, cols


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, projections: int = 48, early: int = 16,
                    window: float = 0.7, cell_window: float = 0.8, recall: float = 0.995, block_rows: int = 2048,
                    cell_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))

    def canonical(batches):
        for batch in batches:
            keys = []
            for v in batch.column(1).to_pylist():
                ok = bool(v) and all(x is not None for x in v)
                a = np.array(v, np.float64) if ok else np.zeros(0)
                if ok and np.isfinite(a).all():
                    top = np.abs(a).max()
                    a = a / top if top else a
                    norm = np.sqrt((a * a).sum())
                    keys.append((a / norm).astype("<f8").tobytes() if norm > 0 else None)
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "v"])

    rows = stored(src.mapInArrow(canonical, "id long, v binary")
                  .withColumn("key", F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), F.sha2("v", 256))), "vectors")
    groups = stored(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("w"),
                                                                      F.first("v").alias("v")), "vector-groups")
    n = groups.count()
    depth = max(0, (max(n, 1) // cell_rows).bit_length())
    cell_window = cell_window_for(threshold, depth, (1 - recall) / 3, cell_window)
    found = _links(groups, n, depth, threshold, projections, early, window, cell_window, recall, block_rows)
    per = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    # equal vectors under several ids, or one id on several vectors, are edges of their own
    linked = groups.join(per.withColumnRenamed("n", "others"), "id", "left")
    same = rows.where("key is not null").select("id", "key").join(groups.select("key", F.col("id").alias("rep")), "key")
    edges = found.where("b is not null").select("a", "b").union(same.where("id <> rep").select("id", "rep"))
    root = components(edges)
    out = rows.select("id", "key").join(linked.select("key", "w", "others"), "key", "left").join(
        root, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"),
                      F.when(F.col("key").isNull(), F.lit(0).cast("long")).otherwise(
                          F.coalesce("others", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _subsets(masks, bit):
    return F.when(F.col("near").bitwiseAND(bit) != 0, F.concat(masks, F.transform(masks, lambda x: x.bitwiseOR(bit)))).otherwise(masks)


def _links(groups: DataFrame, n: int, depth: int, threshold, m, early, window, cell_window, recall, block_rows) -> DataFrame:
    """Rows (a, n, b): links of group ``a`` to other groups' members when b is null, else a merge edge a-b."""
    spark = groups.sparkSession

    def project(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_size.setdefault(len(r), []).append(i)
            lead = np.zeros((len(raw), depth))
            for size, at in by_size.items():
                lead[at] = _units([raw[i] for i in at]) @ directions(size // 8, depth + m)[:, :depth]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(lead), pa.list_(pa.float64()))], names=["id", "w", "v", "lead"])

    led = groups.select("id", "w", "v").mapInArrow(project, "id long, w long, v binary, lead array<double>")
    cuts = [0.0] * depth
    if depth:
        row = led.agg(*[F.percentile_approx(F.col("lead")[i], 0.5, 1000).alias(f"c{i}") for i in range(depth)]).first()
        cuts = [row[i] for i in range(depth)]
    bits = [(F.col("lead")[i] >= c).cast("int") * (1 << i) for i, c in enumerate(cuts)]
    near = [(F.abs(F.col("lead")[i] - c) <= cell_window).cast("int") * (1 << i) for i, c in enumerate(cuts)]
    total = lambda cs: sum(cs, F.lit(0)).cast("long")
    coded = led.select("id", "w", "v", total(bits).alias("code"), total(near).alias("near"), (F.length("v")).alias("size"))
    zero = F.array(F.lit(0).cast("long"))
    bit = F.array(*[F.lit(1 << i).cast("long") for i in range(depth)]) if depth else None
    masks = zero if bit is None else F.aggregate(bit, zero, _subsets)  # of the near bits; nested columns would triple with each bit
    owners = coded.groupBy("size", "code").agg(F.count("*").alias("n"))
    blocks = owners.select("size", F.col("code").alias("cell"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    own = (coded.withColumn("cell", F.col("code")).join(blocks, ["size", "cell"])
           .withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")).withColumn("visitor", F.lit(0)))
    visit = (coded.withColumn("flip", F.explode(masks)).withColumn("cell", F.col("code").bitwiseXOR(F.col("flip"))).drop("flip")
             .join(blocks, ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("visitor", F.lit(1)))
    cols = ["size", "cell", "block", "visitor", "id", "w", "code", "near", "v"]
    dealt = (own.select(cols).unionByName(visit.select(cols)).repartition("size", "cell", "block")
             .sortWithinPartitions("size", "cell", "block", "visitor"))

    def run(batches):
        key, state, held = None, None, []

        def close():
            if state is None:
                return None
            e = state.merger.edges()
            some = np.flatnonzero(state.links)
            a = np.concatenate([state.ids[some], e[0]])
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(np.concatenate([state.links[some], np.zeros(e.shape[1], np.int64)])),
                 pa.array([None] * len(some) + e[1].tolist(), pa.int64())], names=["a", "n", "b"])

        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(cols)}
            num = {f: col[f].to_numpy() for f in ("size", "cell", "block", "visitor", "id", "w", "code", "near")}
            raw = col["v"].to_pylist()
            change = np.flatnonzero(np.any([num[f][1:] != num[f][:-1] for f in ("size", "cell", "block", "visitor")], axis=0)) + 1
            for a, b in zip([0, *change], [*change, len(raw)], strict=True):
                if a == b:
                    continue
                now = tuple(int(num[f][a]) for f in ("size", "cell", "block"))
                if now != key:
                    if (out := close()) is not None:
                        yield out
                    key, state, held = now, None, []
                part = (num["id"][a:b], np.stack([num["code"][a:b], num["near"][a:b]], axis=1), num["w"][a:b], raw[a:b])
                if num["visitor"][a] == 0:
                    held.append(part)
                    continue
                if state is None and held:
                    ids, codes, w = (np.concatenate([h[i] for h in held]) for i in range(3))
                    state = _Block(ids, codes, w, [x for h in held for x in h[3]], window, early, m, recall, threshold, depth)
                    held = []
                if state is not None:
                    if seen := state.meet(*part, depth):
                        a_ids, a_n = (np.concatenate(x) for x in zip(*seen, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a_ids), pa.array(a_n), pa.nulls(len(a_ids), pa.int64())], names=["a", "n", "b"])
        if (out := close()) is not None:
            yield out

    found = dealt.mapInArrow(run, "a long, n long, b long")
    return stored(found, "vector-links")
