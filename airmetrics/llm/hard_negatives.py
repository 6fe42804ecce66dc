"""Operator 13: hard negatives for anchors, found through summaries of vector segments.

A row is (vec_id, label, vector); each component x counts as floor(scale * x), so a score (inner
product) is an exact integer. For each anchor, the positives are its first ``positives`` other rows
of the same label by (score descending, vec_id). For each anchor and positive, the result holds the first
``negatives`` rows of another label whose score lies between ``low``/100 and ``high``/100 of the positive's.

* ``summaries`` writes every row once with its integer components and, for 1, 4 and 16
  segments, each segment's mean and deviation (the root of the summed squared differences to the mean).
  For one segment of length L the inner product lies within L * mean * mean' -+ deviation * deviation',
  so the sums over the segments bound the whole score from above and below.
* Anchors are the stated query set. They go to the rows in blocks of about ``block`` (a bounded broadcast:
  the block's vectors, summaries and at most ``positives`` scores an anchor), the rows stay where they are.
  In a task the bounds are taken for one segment first; the pairs left go on to 4 and 16 segments, and only those
  left after that are scored exactly. A pair is dropped when its upper bound lies below what
  the anchor still needs (its k-th best exact score of this task, or the lower end of its window) or its lower bound
  above all of its windows; so no result is lost. Bounds are widened by the rounding of doubles.
* Each task returns its own best rows per anchor (or window); one ranked merge of those by anchor gives the result.
  A label that holds most rows is spread like any other, since nothing is grouped by label.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, or with a
component whose scores could leave the range of a long, take no part; missing components of
shorter vectors count as 0; ties go to the smaller vec_id. Rows that share the anchor's vec_id are none of its positives;
otherwise repeated rows count as often as they stand; anchors alike in id, label and components count once. A positive score of 0 or
less admits negatives only where the window is not empty. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.llm.common import stored
from airmetrics.session import scratch_path

LEVELS = (1, 4, 16)
ROWS, ANCHORS = 2048, 256  # one tile of pairs in a task
_NONE = np.iinfo(np.int64).min


def _integers(column: pa.Array, scale: int, width: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row mask, components of those rows): floor(scale * x) as int64, padded with 0 to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out, ok = np.zeros((len(column), width), np.int64), np.zeros(len(column), bool)
    for i, vector in enumerate(column):
        values = vector.values
        if values is None or values.null_count:
            continue
        x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if len(x) == 0 or (np.abs(x) <= limit).all():  # false for NaN and infinite components
            out[i, :len(x)], ok[i] = x, True
    return ok, out[ok]


def summary(q: np.ndarray) -> np.ndarray:
    """Per row: for each level the means of its segments, then their deviations."""
    parts = []
    for n in LEVELS:
        s = q.reshape(len(q), n, q.shape[1] // n).astype(np.float64)
        mean = s.mean(axis=2)
        parts += [mean, np.sqrt(((s - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(parts, axis=1) if len(q) else np.zeros((0, 2 * sum(LEVELS)))


def summaries(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
              scale: int = 256) -> tuple[DataFrame, int]:
    """The written table (vec_id, label, q, summary) of all rows that take part, and the padded width."""
    src = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("long").alias("label"),
                      rows[vector_col].cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    widest = src.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(-(-widest // LEVELS[-1]) * LEVELS[-1], LEVELS[-1])
    limit = float(int((2 ** 62 / width) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, q = _integers(b.column("v"), scale, width, limit)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").filter(keep), b.column("label").filter(keep),
                 pa.array([r.tobytes() for r in q.astype("<i8")], pa.binary()),
                 pa.array([r.tobytes() for r in summary(q).astype("<f8")], pa.binary())], ["vec_id", "label", "q", "summary"])

    return stored(src.mapInArrow(run, "vec_id long, label long, q binary, summary binary"), "segment-summaries"), width


def _matrix(column, dtype: str, width: int) -> np.ndarray:
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), width)


def _cut(s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) per level."""
    out, at = [], 0
    for n in LEVELS:
        out.append((s[:, at:at + n], s[:, at + n:at + 2 * n]))
        at += 2 * n
    return out


class Side:
    """Vectors of one side of the pairs, with their summaries."""

    def __init__(self, ids, labels, q, s):
        self.ids, self.labels, self.q = ids, labels, q
        self.levels, self.f = _cut(s), q.astype(np.float64)
        self.norm = np.sqrt((self.f ** 2).sum(axis=1))
        self.top = float(np.abs(self.f).max()) if self.f.size else 0.0

    def part(self, at) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.q, out.f, out.norm = self.ids[at], self.labels[at], self.q[at], self.f[at], self.norm[at]
        out.levels, out.top = [(m[at], d[at]) for m, d in self.levels], self.top
        return out


def scored_pairs(a: Side, r: Side, mask: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs in ``mask`` whose score may lie in [least, most] of the anchor."""
    rows, cols = np.arange(len(a.ids)), np.arange(len(r.ids))
    width = a.q.shape[1]
    for level, n in enumerate(LEVELS):
        keep_r, keep_c = mask.any(axis=1), mask.any(axis=0)
        if not keep_r.any():
            return rows[:0], cols[:0], np.zeros(0, np.int64)
        if not (keep_r.all() and keep_c.all()):
            mask, rows, cols = mask[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
        (ma, da), (mr, dr) = (x.levels[level] for x in (a, r))
        middle = (ma[rows] * (width // n)) @ mr[cols].T
        spread = da[rows] @ dr[cols].T + 1e-9 * a.norm[rows, None] * r.norm[None, cols] + 1e-6
        mask = mask & (middle + spread >= least[rows, None]) & (middle - spread <= most[rows, None])
    i, j = np.nonzero(mask)
    if a.top * r.top * width < 2 ** 53 and len(i) * 20 > mask.size:  # doubles are exact here
        score = (a.f[rows] @ r.f[cols].T)[i, j].astype(np.int64)
        return rows[i], cols[j], score
    i, j = rows[i], cols[j]
    score = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = np.einsum("ij,ij->i", a.q[i[part]], r.q[j[part]])
    return i, j, score


class Best:
    """The best ``k`` (score, id) of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.kth = k, np.full(slots, _NONE)
        self.slot = self.id = self.score = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = (np.concatenate(p) for p in ((self.slot, slot), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.slot, self.id, self.score = slot[keep], ids[keep], score[keep]
        full = place[keep] == self.k - 1
        self.kth[self.slot[full]] = self.score[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.slot), pa.array(self.id), pa.array(self.score)], ["slot", "id", "score"])


def _search(rows: DataFrame, shared, width: int, k: int, windows: bool) -> DataFrame:
    """(slot, id, score): each task's best rows per slot. Slots are anchors, or windows (anchor, positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, s, owner, least, most = shared.value
        every = Side(ids, labels, q, s)
        slots = len(owner) if windows else len(ids)
        best = Best(slots, k)
        first = np.searchsorted(owner, np.arange(len(ids) + 1)) if windows else None
        for b in batches:
            whole = Side(b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("q"), "<i8", width),
                         _matrix(b.column("summary"), "<f8", 2 * sum(LEVELS)))
            for at in range(0, len(whole.ids), ROWS):
                r = whole.part(slice(at, at + ROWS))
                for low in range(0, len(ids), ANCHORS):
                    span = np.arange(low, min(low + ANCHORS, len(ids)))
                    a = every.part(span)
                    same = a.labels[:, None] == r.labels[None, :]
                    if not windows:
                        i, j, score = scored_pairs(a, r, same & (a.ids[:, None] != r.ids[None, :]), best.kth[span].astype(np.float64),
                                                   np.full(len(span), np.inf))
                        best.add(span[i], r.ids[j], score)
                        continue
                    need = np.maximum(least, best.kth).astype(np.float64)
                    lo, hi = np.full(len(span), np.inf), np.full(len(span), -np.inf)
                    mine = np.arange(first[low], first[span[-1] + 1])
                    np.minimum.at(lo, owner[mine] - low, need[mine])
                    np.maximum.at(hi, owner[mine] - low, most[mine].astype(np.float64))
                    i, j, score = scored_pairs(a, r, ~same, lo, hi)
                    # every pair meets the windows of its anchor
                    n = np.diff(first)[span[i]]
                    pair = np.repeat(np.arange(len(i)), n)
                    slot = first[span[i]][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                    fits = (score[pair] >= least[slot]) & (score[pair] <= most[slot])
                    best.add(slot[fits], r.ids[j[pair[fits]]], score[pair[fits]])
        yield best.batch()

    found = rows.select("vec_id", "label", "q", "summary").mapInArrow(run, "slot long, id long, score long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, block: int = 2048, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a test on ``vec_id``."""
    spark = rows.sparkSession
    table, width = summaries(rows, id_col, label_col, vector_col, scale)
    anchors = table.where(is_anchor).dropDuplicates(["vec_id", "label", "q"])
    n = table.where(is_anchor).count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks))), "anchors")
    else:
        anchors = anchors.withColumn("block", F.lit(0))
    path = f"{scratch_path(spark, 'llm')}/hard-negatives-{uuid.uuid4().hex}"
    schema = ("anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        held = anchors.where(F.col("block") == b).orderBy("vec_id", "label", "q").collect()
        side = (np.array([r["vec_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64),
                _matrix([bytes(r["q"]) for r in held], "<i8", width), _matrix([bytes(r["summary"]) for r in held], "<f8", 2 * sum(LEVELS)))
        none = np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast((*side, none, none, none))
        top = sorted(_search(table, shared, width, positives, False).collect(), key=lambda r: (r["slot"], r["rank"]))
        owner, score = (np.array([r[c] for r in top], np.int64) for c in ("slot", "score"))
        # low * positive <= 100 * negative <= high * positive, in whole numbers of any size
        least = np.array([-((-low * int(s)) // 100) for s in score], np.int64)
        most = np.array([high * int(s) // 100 for s in score], np.int64)
        windows = spark.sparkContext.broadcast((*side, owner, least, most))
        named = spark.createDataFrame(
            [(s, int(side[0][r["slot"]]), r["id"], r["rank"], r["score"]) for s, r in enumerate(top)],
            "slot long, anchor_id long, positive_id long, positive_rank int, positive_score long")
        (_search(table, windows, width, negatives, True).join(F.broadcast(named), "slot")
         .select("anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path))
        shared.unpersist()
        windows.unpersist()
    return spark.read.schema(schema).parquet(path)


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` take the next label."""
    label = F.when(rows["vec_id"] % every == 0, (rows["label"] + 1) % labels).otherwise(rows["label"])
    return rows.select(rows["vec_id"], label.alias("label"), rows["embedding"])
