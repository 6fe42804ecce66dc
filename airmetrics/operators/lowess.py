"""LOWESS trend curve (A9 curve) as distributed DataFrame jobs.

Definition (local linear fit, tricube weights, then robustness passes):
for every distinct x0, ``k = int(frac * n + 1e-10)`` rows nearest to x0 define
the radius h (the k-th smallest |x - x0| over all rows); rows with
|x - x0| < h get weight (1 - (|x - x0| / h)^3)^3 and the fitted value is the
weighted least-squares line evaluated at x0 (the weighted mean when all weight
sits on one x). h = 0 (k rows at x0 itself) gives the mean at x0. Each
robustness pass multiplies every row's weight by the bisquare of its residual
over 6 x the median absolute residual (0 beyond), and fits again over the same
neighbourhoods.

Plan, all exact:
1. rows -> distinct (x, y) with their count (partial aggregation; a hot x value
   never gathers its rows in one task), checkpointed: every later step reads
   this lossless summary instead of the rows; per x: (count, sum y);
2. ranks from a distributed running sum (``scan.prefix_scan``);
3. the radius: the k nearest rows form a contiguous run in x order, and an
   optimal run starts at the first row of a value or ends at the last row of a
   value, so 2 candidate runs per distinct x suffice. For a run [l, r],
   max(|x0 - l|, |r - x0|) is x0 - l if its midpoint <= x0 and r - x0 otherwise,
   so h(x0) = min(x0 - max{l : mid <= x0}, min{r : mid > x0} - x0): two more
   running scans (max forward, min backward) instead of any pairing;
4. the window of x0 is a range of places among the distinct values, cut at x0 into a left and a
   right side. Places are grouped into blocks of 1, 2, 4, ... consecutive values; each side is the
   union of at most two blocks a size. No value is paired with another: a row holds x0 and its
   block list, so g distinct values give g rows (and 2 log2 g block references each);
5. within one side the tricube weight is a polynomial of degree 9 in t = x - x0, so the five weighted
   sums of the fit need only the moments sum c t^j (j <= 11) and sum sy t^j (j <= 10). Every block keeps them about
   its own middle, and they are shifted to x0. A used block lies inside its window, so both the shift and
   the block are no wider than h and the shifted sums lose no digits that count (about 1e-13 of the weight; a fit whose
   only weight lies within about 1e-4 h of the window's ends is decided by rounding);
6. robustness passes: points join the curve on x, the median absolute residual
   comes from the distributed exact quantile, and the blocks' moments are rebuilt
   with the row weights; the windows are reused.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.operators.joins import DEFAULT_BROADCAST_ROWS
from airmetrics.operators.scan import blocks_for, exact_quantiles, prefix_scan
from airmetrics.session import cut_lineage

# The span and the number of robustness passes the reference's
# plotting call uses (its default trend-line options).
DEFAULT_FRAC = 0.6666666
DEFAULT_ITERATIONS = 3


def lowess(df: DataFrame, x: str, y: str, frac: float = DEFAULT_FRAC, iterations: int = DEFAULT_ITERATIONS,
           blocks: int | None = None, digits: int | None = 6, direct: int = 200) -> DataFrame:
    """-> (<x>, n, fitted), one row per distinct non-null x. Up to ``direct`` distinct
    values the sums are taken over the window's values themselves."""
    pts = (df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
           .where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")))
    # points reduced to distinct (x, y) with their count: lossless, and every later
    # step (grid, residuals, median, weights) reads this instead of the rows
    xy = cut_lineage(pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("cnt")))
    grid = xy.groupBy("x").agg(F.sum("cnt").alias("c"), F.sum(F.col("cnt") * F.col("y")).alias("sy"))
    stats = grid.agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                     F.count(F.lit(1)).alias("g")).first()
    n = stats["n"] or 0
    if n == 0:
        return grid.select(F.col("x").alias(x), F.col("c").alias("n"), F.lit(None).cast("double").alias("fitted")).limit(0)
    k = max(1, min(n, int(frac * n + 1e-10)))
    # scans run over at most 3 rows per distinct x: size the blocks from that
    blocks = blocks or blocks_for(3 * stats["g"])

    # 2. ranks: rows of value x occupy 0-based ranks [first, last]
    ranked = (prefix_scan(grid, "x", {"cum": ("sum", "c")}, blocks=blocks)
              .select("x", "c", "sy", (F.col("cum") - F.col("c")).alias("first"), (F.col("cum") - 1).alias("last")))

    # 3a. candidate runs of k rows; the missing end is the value at a rank
    a = ranked.where(F.col("first") + k - 1 <= n - 1).select(
        (F.col("first") + k - 1).alias("key"), F.lit("A").alias("side"), F.col("x").alias("known"))
    b = ranked.where(F.col("last") - k + 1 >= 0).select(
        (F.col("last") - k + 1).alias("key"), F.lit("B").alias("side"), F.col("x").alias("known"))
    lookup = (ranked.select(F.col("first").alias("key"), F.lit(0).alias("tag"), F.col("x").alias("val"),
                            F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("known"))
              .unionByName(a.unionByName(b).select("key", F.lit(1).alias("tag"), F.lit(None).cast("double").alias("val"),
                                                   "side", "known")))
    at = prefix_scan(lookup, "key", {"at": ("last", "val")}, blocks=blocks, tiebreak=["tag"]).where(F.col("tag") == 1)
    runs = at.select(F.when(F.col("side") == "A", F.col("known")).otherwise(F.col("at")).alias("l"),
                     F.when(F.col("side") == "A", F.col("at")).otherwise(F.col("known")).alias("r")).distinct()

    # 3b. radius per distinct x0 from two running scans over runs + probes
    mid = (F.col("l") + F.col("r")) / 2
    probes = ranked.select(F.col("x").alias("x0"), F.col("c").alias("c0"))
    fw = (runs.select(mid.alias("key"), F.lit(0).alias("tag"), F.col("l").alias("lval"),
                      F.lit(None).cast("double").alias("x0"), F.lit(None).cast("long").alias("c0"))
          .unionByName(probes.select(F.col("x0").alias("key"), F.lit(1).alias("tag"),
                                     F.lit(None).cast("double").alias("lval"), "x0", "c0")))
    fw = prefix_scan(fw, "key", {"maxl": ("max", "lval")}, blocks=blocks, tiebreak=["tag"]) \
        .where(F.col("tag") == 1).select("x0", "c0", "maxl")
    bw = (runs.select((-mid).alias("key"), F.lit(1).alias("tag"), F.col("r").alias("rval"),
                      F.lit(None).cast("double").alias("x0"))
          .unionByName(probes.select((-F.col("x0")).alias("key"), F.lit(0).alias("tag"),
                                     F.lit(None).cast("double").alias("rval"), "x0")))
    bw = prefix_scan(bw, "key", {"minr": ("min", "rval")}, blocks=blocks, tiebreak=["tag"]) \
        .where(F.col("tag") == 0).select("x0", "minr")
    # sides with one row per distinct x are broadcast when that count is within the bound
    small = (lambda d: F.broadcast(d)) if stats["g"] <= DEFAULT_BROADCAST_ROWS else (lambda d: d)
    radius = fw.join(small(bw), "x0").select(
        "x0", "c0", F.least(F.col("x0") - F.col("maxl"), F.col("minr") - F.col("x0")).alias("h"))

    if stats["g"] <= direct:
        # so few values: at most direct^2 rows, which cost less than the moments' plan
        values = F.broadcast(grid.select("x", F.lit(0).alias("one")))
        u = F.abs(F.col("x") - F.col("x0")) / F.col("h")
        near = radius.withColumn("one", F.lit(0)).join(values, "one").where((F.abs(F.col("x") - F.col("x0")) < F.col("h")) | (F.col("x") == F.col("x0")))
        near = cut_lineage(near.select("x0", "c0", "x", F.when(F.col("h") > 0, (1 - u * u * u) * (1 - u * u * u) * (1 - u * u * u))
                                       .otherwise(1.0).alias("w")))
        fit = lambda grid: _fit_direct(near, grid)
    else:
        # 4. places of the distinct values, and each window as a range of places
        places = cut_lineage(prefix_scan(grid.select("x"), "x", {"at": ("sum", F.lit(1))}, blocks=blocks)
                             .select("x", (F.col("at") - 1).alias("at")))
        ends = radius.select("x0", "c0", "h", (F.col("x0") - F.col("h")).alias("lo"), (F.col("x0") + F.col("h")).alias("hi"))
        low, high = _places_at(places, ends, "lo", blocks, before=True), _places_at(places, ends, "hi", blocks, before=False)
        ranges = ends.join(small(low), "x0").join(small(high), "x0").join(small(places.withColumnRenamed("x", "x0")), "x0")
        windows = cut_lineage(ranges.select("x0", "c0", "h", F.concat(_block_list("lo_at", "at + 1", stats["g"], -1),
                                                                      _block_list("at + 1", "hi_at + 1", stats["g"], 1)).alias("parts")))
        middles = cut_lineage(_in_blocks(places, stats["g"]).groupBy("l", "b").agg(((F.min("x") + F.max("x")) / 2).alias("m")))
        fit = lambda grid: _fit(windows, places, middles, grid, stats["g"])

    fitted = fit(grid)
    for _ in range(iterations):
        fitted = cut_lineage(fitted)
        fitted = fit(_robust_grid(xy, fitted, stats["g"], n))
    out = fitted.select(F.col("x0").alias(x), F.col("c0").alias("n"), "fitted")
    if digits is not None:
        out = out.withColumn("fitted", F.round("fitted", digits))
    return out


def _places_at(places: DataFrame, ends: DataFrame, end: str, blocks: int, before: bool) -> DataFrame:
    """(x0, <end>_at): the place of the first value >= ``end`` (``before``) or of the last value <= ``end``."""
    values = places.select(F.col("x").alias("key"), F.lit(1 if before else 0).alias("tag"), "at", F.lit(None).cast("double").alias("x0"))
    probes = ends.select(F.col(end).alias("key"), F.lit(0 if before else 1).alias("tag"), F.lit(None).cast("long").alias("at"), "x0")
    found = prefix_scan(values.unionByName(probes), "key", {"found": ("last", "at")}, blocks=blocks, tiebreak=["tag"]).where("x0 is not null")
    at = F.coalesce(F.col("found"), F.lit(-1)) + 1 if before else F.col("found")
    return found.select("x0", at.alias(f"{end}_at"))


def _levels(distinct_x: int) -> int:
    return max(distinct_x - 1, 0).bit_length()


def _block_list(start: str, stop: str, distinct_x: int, side: int):
    """array<struct<l, b, side>>: the blocks of 2^l places that make up the places [start, stop)."""
    first, last = f"shiftright(({start}) + shiftleft(1L, l) - 1, l)", f"shiftright({stop}, l)"
    at = (f"filter(array(if({first} < {last} and {first} % 2 = 1, {first}, null), "
          f"if({first} < {last} and {last} % 2 = 1, {last} - 1, null)), b -> b is not null)")
    return F.expr(f"flatten(transform(sequence(0, {_levels(distinct_x)}), l -> transform({at}, "
                  f"b -> named_struct('l', l, 'b', b, 'side', {side}))))")


def _in_blocks(places: DataFrame, distinct_x: int) -> DataFrame:
    """Every value with the block it has at each size."""
    return places.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(_levels(distinct_x))))).withColumn("b", F.expr("shiftright(at, l)"))


def _fit(windows: DataFrame, places: DataFrame, middles: DataFrame, grid: DataFrame, distinct_x: int) -> DataFrame:
    """5. weighted least squares at each x0 from the moments of the blocks of its window
    and the per-x weight and weighted y sums (c, sy) -> (x0, c0, fitted)."""
    bounded = (lambda d: F.broadcast(d)) if 2 * distinct_x <= DEFAULT_BROADCAST_ROWS else (lambda d: d)
    # expressions of many terms are given as text: one call each instead of one per operator
    moments = (_in_blocks(places.join(bounded(grid), "x"), distinct_x).join(bounded(middles), ["l", "b"])
               .selectExpr("l", "b", "m", "c", "sy", *[f"pow(x - m, {k}) AS z{k}" for k in range(12)])
               .groupBy("l", "b").agg(F.first("m").alias("m"), *[F.expr(f"sum(c * z{k}) AS mc{k}") for k in range(12)],
                                      *[F.expr(f"sum(sy * z{k}) AS my{k}") for k in range(11)]))
    parts = windows.select("x0", "c0", "h", F.explode("parts").alias("p")).select(
        "x0", "c0", F.when(F.col("h") > 0, F.col("h")).otherwise(1.0).alias("h"), "p.l", "p.b", "p.side")
    # everything is measured in radii from here on; powers and shifted moments stand in projections of
    # their own, so that each is computed once
    j = parts.join(bounded(moments), ["l", "b"]).selectExpr(
        "x0", "c0", "h", "cast(side AS double) AS s", *[f"pow((m - x0) / h, {k}) AS d{k}" for k in range(12)],
        *[f"mc{k} * pow(1 / h, {k}) AS mc{k}" for k in range(12)], *[f"my{k} * pow(1 / h, {k}) AS my{k}" for k in range(11)])

    def shifted(name: str, k: int) -> str:
        """sum of c (or sy) times ((x - x0) / h)^k over the block."""
        return " + ".join(f"{comb(k, i)}D * m{name}{i} * d{k - i}" for i in range(k + 1)) + f" AS t{name}{k}"

    j = j.selectExpr("x0", "c0", "h", "s", *[shifted("c", k) for k in range(12)], *[shifted("y", k) for k in range(11)])

    def weighted(name: str, p: int, out: str):
        """The same with the tricube weight 1 - 3|u|^3 + 3|u|^6 - |u|^9."""
        return F.expr(f"sum(t{name}{p} - 3 * s * t{name}{p + 3} + 3 * t{name}{p + 6} - s * t{name}{p + 9}) AS {out}")

    sums = j.groupBy("x0", "c0", "h").agg(weighted("c", 0, "W"), weighted("c", 1, "Sx"), weighted("c", 2, "Sxx"),
                                          weighted("y", 0, "Sy"), weighted("y", 1, "Sxy"))
    return _line(sums, "h")


def _fit_direct(near: DataFrame, grid: DataFrame) -> DataFrame:
    """The same from the windows' values (x0, c0, x, w)."""
    t = F.col("x") - F.col("x0")
    sums = near.join(F.broadcast(grid), "x").groupBy("x0", "c0").agg(
        F.sum(F.col("w") * F.col("c")).alias("W"), F.sum(F.col("w") * F.col("c") * t).alias("Sx"), F.sum(F.col("w") * F.col("c") * t * t).alias("Sxx"),
        F.sum(F.col("w") * F.col("sy")).alias("Sy"), F.sum(F.col("w") * F.col("sy") * t).alias("Sxy"))
    return _line(sums, "1D")


def _line(sums: DataFrame, unit: str) -> DataFrame:
    """The weighted line at x0 from sums taken in ``unit`` around x0; the weighted mean
    where all weight sits on one x, null without weight."""
    means = sums.selectExpr("x0", "c0", "W", f"Sx / nullif(W, 0D) * {unit} AS dx", "Sy / nullif(W, 0D) AS ybar",
                            f"Sxx / nullif(W, 0D) * {unit} * {unit} AS dxx", f"Sxy / nullif(W, 0D) * {unit} AS dxy")
    return means.selectExpr("x0", "c0", "W", "dx", "ybar", "dxx - dx * dx AS var", "dxy - dx * ybar AS cov").selectExpr(
        "x0", "c0", "CASE WHEN W <= 0 THEN cast(null AS double) WHEN var > 1e-9D * ((x0 + dx) * (x0 + dx) + 1D) "
        "THEN ybar - dx * cov / var ELSE ybar END AS fitted")


def _robust_grid(xy: DataFrame, fitted: DataFrame, distinct_x: int, n: int) -> DataFrame:
    """One robustness pass over the distinct (x, y, cnt) points: residuals
    against the current curve, bisquare weights scaled by 6 x the median absolute
    residual (exact, distributed, count-weighted), and the per-x weight sums for
    the next fit."""
    curve = fitted.select(F.col("x0").alias("x"), "fitted")
    # the curve has one row per distinct x: its size is known, no count needed
    curve = F.broadcast(curve) if distinct_x <= DEFAULT_BROADCAST_ROWS else curve
    # a point whose neighbourhood has no weight left has no fit; it counts as
    # fitted by its own value (residual 0), so every point has a residual
    res = xy.join(curve, "x").select(
        "x", "y", "cnt", F.abs(F.col("y") - F.coalesce(F.col("fitted"), F.col("y"))).alias("r"))
    m = exact_quantiles(res, "r", [0.5], n=n, weight="cnt").first()[0]
    if m is None:
        delta = F.lit(0.0)
    elif m == 0:
        delta = F.when(F.col("r") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        u = F.col("r") / F.lit(6.0 * m)
        delta = F.when(u >= 1, F.lit(0.0)).otherwise((F.lit(1.0) - u * u) * (F.lit(1.0) - u * u))
    weighted = res.select("x", "y", (F.col("cnt") * F.coalesce(delta, F.lit(0.0))).alias("d"))
    return weighted.groupBy("x").agg(F.sum("d").alias("c"), F.sum(F.col("d") * F.col("y")).alias("sy"))
