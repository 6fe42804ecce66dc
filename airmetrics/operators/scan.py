"""Distributed prefix scans over a global order.

A window with ``orderBy`` and no ``partitionBy`` runs in a single task. The scan
here splits the key range into blocks at approximate quantiles (only the block
boundaries reach the driver), computes each block's running aggregate with a
block-partitioned window, and adds the aggregate of all earlier blocks, taken
from a per-block summary whose size is bounded by the number of blocks.

The input should be unique on the order key (pre-aggregate duplicates first):
a block can then hold at most ~1/blocks of the rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLK = "_scan_blk"
ROWS_PER_BLOCK = 1_000_000


MAX_BLOCKS = 10_000  # block boundaries reach the driver: keep their count bounded


def blocks_for(rows: int, max_blocks: int | None = MAX_BLOCKS, per_block: int | None = None) -> int:
    """Block count for a scan over ``rows`` rows: one block (one task) while the
    input is at most ``per_block`` rows, more as it grows (capped at max_blocks)."""
    per_block = per_block or ROWS_PER_BLOCK
    n = max(1, -(-int(rows) // per_block))
    return min(n, max_blocks) if max_blocks else n


def _block_count(df: DataFrame, blocks: int | None) -> int:
    if blocks:
        return max(1, int(blocks))
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_blocks(df: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """Add a block id that increases with ``key`` (numeric)."""
    n = _block_count(df, blocks)
    keyd = f"{_BLK}_key"
    d = df.withColumn(keyd, F.col(key).cast("double"))
    if n == 1:
        return d.withColumn(_BLK, F.lit(0.0)).drop(keyd)
    qs = d.approxQuantile(keyd, [i / n for i in range(1, n)], 0.001)
    splits = [float("-inf")] + sorted(set(q for q in qs if q is not None)) + [float("inf")]
    if len(splits) < 3:
        return d.withColumn(_BLK, F.lit(0.0)).drop(keyd)
    out = Bucketizer(splits=splits, inputCol=keyd, outputCol=_BLK, handleInvalid="keep").transform(d)
    return out.drop(keyd)


_OPS = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    # last non-null value so far (as-of lookup)
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def prefix_scan(df: DataFrame, key: str, specs: dict[str, tuple[str, str | Column]],
                blocks: int | None = None, inclusive: bool = True,
                tiebreak: list[str] | None = None) -> DataFrame:
    """Running aggregates in ascending ``key`` order.

    ``specs``: output column -> (op, value column) with op in sum/min/max/last.
    ``inclusive=False`` gives the aggregate of strictly earlier rows.
    ``tiebreak``: further ordering columns among rows with the same key (rows
    with equal keys always share a block).
    """
    vals = {out: (F.col(v) if isinstance(v, str) else v) for out, (_, v) in specs.items()}
    hi = Window.currentRow if inclusive else -1
    if _block_count(df, blocks) == 1:
        # one block: the running aggregate is the answer (the caller sized the
        # input, see ``blocks_for``), no offsets to add
        w = Window.orderBy(key, *(tiebreak or [])).rowsBetween(Window.unboundedPreceding, hi)
        outs = [_OPS[op][0](vals[o]).over(w) for o, (op, _) in specs.items()]
        outs = [F.coalesce(c, F.lit(0)) if op == "sum" else c for c, (op, _) in zip(outs, specs.values())]
        return df.select(*df.columns, *[c.alias(o) for c, o in zip(outs, specs)])
    b = with_blocks(df, key, blocks)
    summary = b.groupBy(_BLK).agg(*[
        (F.sum(vals[o]) if op == "sum" else F.min(vals[o]) if op == "min" else
         F.max(vals[o]) if op == "max" else F.max_by(vals[o], F.when(vals[o].isNotNull(), F.col(key))))
        .alias(f"_tot_{o}") for o, (op, _) in specs.items()])
    before = Window.orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    offs = summary.select(_BLK, *[_OPS[op][0](F.col(f"_tot_{o}")).over(before).alias(f"_off_{o}")
                                  for o, (op, _) in specs.items()])
    w = Window.partitionBy(_BLK).orderBy(key, *(tiebreak or [])).rowsBetween(Window.unboundedPreceding, hi)
    within = b.select("*", *[_OPS[op][0](vals[o]).over(w).alias(f"_in_{o}") for o, (op, _) in specs.items()])
    # ``offs`` has one row per block: bounded by the block count, safe to broadcast.
    j = within.join(F.broadcast(offs), _BLK, "left")
    out = j.select(*df.columns, *[_OPS[op][1](F.col(f"_in_{o}"), F.col(f"_off_{o}")).alias(o)
                                  if op != "sum" else
                                  (F.coalesce(F.col(f"_in_{o}"), F.lit(0)) + F.coalesce(F.col(f"_off_{o}"), F.lit(0))).alias(o)
                                  for o, (op, _) in specs.items()])
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], n: int | None = None,
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / percentile_cont).

    Values are first reduced to (value, count), then ranks come from a
    distributed running sum; no task sees all values. -> one row, columns q0..qk.
    ``n``: the number of non-null values when the caller knows it (saves a job).
    ``weight``: an integer column giving how many times each row's value occurs
    (input already reduced to distinct values with counts).
    """
    cnt = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    v = df.select(F.col(col).cast("double").alias("v"), cnt.alias("_w")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    g = v.groupBy("v").agg(F.sum("_w").alias("c"))
    if n is None:
        st = g.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct")).first()
        n, distinct = st["n"] or 0, st["distinct"]
    else:
        distinct = n  # an upper bound is enough to size the blocks
    if n == 0:
        return g.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probs))])
    s = prefix_scan(g, "v", {"cum": ("sum", "c")}, blocks=blocks_for(distinct))
    aggs = []
    for i, p in enumerate(probs):
        pos = p * (n - 1)
        lo, hi = int(pos // 1), int(-(-pos // 1))
        frac = pos - lo

        def at(r):  # 0-based rank r lies in [cum - c, cum - 1]
            return F.min(F.when((F.col("cum") - F.col("c") <= r) & (F.lit(r) < F.col("cum")), F.col("v")))
        aggs += [at(lo).alias(f"_lo{i}"), at(hi).alias(f"_hi{i}")]
    one = s.agg(*aggs)
    outs = []
    for i, p in enumerate(probs):
        pos = p * (n - 1)
        frac = pos - int(pos // 1)
        outs.append((F.col(f"_lo{i}") + F.lit(frac) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return one.select(*outs)
