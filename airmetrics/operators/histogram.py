"""Equal-width histogram with "nice" bin widths (A3, M6).

Width = the smallest 1·10^k, 2·10^k or 5·10^k that is >= (max - min) / (bins - 1);
edges sit at multiples of the width, so there are never more than ``bins`` bins.
max == min gives width 1. Two passes over the input: one aggregate for the
bounds (a single row reaches the driver), one grouped count on the bin index.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nice_width(lo: float, hi: float, bins: int) -> float:
    if bins < 2 or hi <= lo:
        return 1.0
    target = (hi - lo) / (bins - 1)
    k = math.floor(math.log10(target))
    best = None
    for e in (k - 1, k, k + 1):
        for m in (1.0, 2.0, 5.0):
            w = m * math.pow(10.0, e)
            if w >= target and (best is None or w < best):
                best = w
    return best


def histogram(df: DataFrame, col: str, bins: int = 50, weight: str | None = None) -> DataFrame:
    """-> (bin_start, bin_end, n) for the non-null values of ``col``; ``weight``: how many rows each row stands for."""
    count = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    vals = df.select(F.col(col).cast("double").alias("v"), count.alias("w")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    bounds = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if bounds is None or bounds["lo"] is None:
        return vals.select(F.lit(0.0).alias("bin_start"), F.lit(0.0).alias("bin_end"),
                           F.lit(0).cast("long").alias("n")).limit(0)
    w = nice_width(bounds["lo"], bounds["hi"], bins)
    start = (F.floor(F.col("v") / F.lit(w)).cast("double") * F.lit(w))
    return (vals.groupBy(start.alias("bin_start"))
            .agg((F.sum("w") if weight else F.count(F.lit(1))).alias("n"))
            .select("bin_start", (F.col("bin_start") + F.lit(w)).alias("bin_end"), "n")
            .orderBy("bin_start"))
