"""Profiling (P1-P6): head, describe, info, count, columns, date bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.session import cut_lineage

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
_NUMERIC = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def head(df: DataFrame, n: int = 5, key: str = "flight_id") -> DataFrame:
    """First n rows in key order (a distributed table has no other 'first')."""
    return df.orderBy(key).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True,
             accuracy: int = 10000) -> DataFrame:
    """Count, mean, std, min, quartiles, max per numeric column
    -> (column_name, stat, value). One aggregation pass for the moments; quartiles
    are exact (``column_quantiles``) or ``percentile_approx`` when ``exact=False``."""
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, stat string, value double")
    moments = df.agg(*[e for c in cols for e in (
        F.count(c).cast("double").alias(f"{c}__count"),
        F.avg(c).alias(f"{c}__mean"),
        F.round(F.stddev_samp(c), 9).alias(f"{c}__std"),
        F.min(c).cast("double").alias(f"{c}__min"),
        F.max(c).cast("double").alias(f"{c}__max"),
        *([] if exact else [F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q")]))])
    m_rows = [F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"),
                       F.col(f"{c}__{k}").cast("double").alias("value"))
              for c in cols for s, k in [("count", "count"), ("mean", "mean"), ("std", "std"),
                                         ("min", "min"), ("max", "max")]]
    names = ["25%", "50%", "75%"]
    if not exact:
        m_rows += [F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("stat"), F.col(f"{c}__q")[i].alias("value"))
                   for c in cols for i, s in enumerate(names)]
    long_m = moments.select(F.explode(F.array(*m_rows)).alias("r")).select("r.*")
    if not exact:
        return long_m
    quart = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    long_q = quart.select("column_name", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(f"q{i}").alias("value"))
        for i, s in enumerate(names)])).alias("r")).select("column_name", "r.stat", "r.value")
    return long_m.unionByName(long_q)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of several columns in one pass
    -> (column_name, q0..qk), one row per column, null without values.

    All values become (column, value, count), dealt by range of (column, value) and
    checkpointed, so the ranges stay as they are; a running sum inside each range plus the
    rows of the ranges before it gives every value's rank. Only one row count per range and
    per column is brought together.
    """
    entries = [F.struct(F.lit(i).alias("ci"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)]
    values = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.ci", "e.v")
              .where(F.col("v").isNotNull() & ~F.isnan("v")))
    counts = values.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("c"))
    dealt = cut_lineage(counts.repartitionByRange("ci", "v").withColumn("part", F.spark_partition_id()))
    totals = {r["ci"]: r["n"] for r in dealt.groupBy("ci").agg(F.sum("c").alias("n")).collect()}  # one row per column
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.sum("c").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("ci", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per range: safe to broadcast
    ranked = dealt.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(offsets), "part").select(
        "ci", "v", "c", (F.col("upto") + F.col("before")).alias("upto"))
    start, wanted = 0, []
    for i in range(len(cols)):
        n = totals.get(i, 0)
        spots = [p * (n - 1) for p in probs] if n else []
        wanted.append(([start + int(x // 1) for x in spots], [start + int(-(-x // 1)) for x in spots],
                       [x - x // 1 for x in spots]))
        start += n

    def value_at(ranks: list[tuple[int, int]]):
        """The value that holds the rank named for its column."""
        rank = None
        for i, r in ranks:
            rank = F.when(F.col("ci") == i, F.lit(r).cast("long")) if rank is None else rank.when(F.col("ci") == i, F.lit(r).cast("long"))
        rank = F.lit(None).cast("long") if rank is None else rank
        return F.min(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))

    have = [(i, w) for i, w in enumerate(wanted) if w[0]]
    found = ranked.groupBy("ci").agg(*[e for k in range(len(probs)) for e in (
        value_at([(i, w[0][k]) for i, w in have]).alias(f"lo{k}"), value_at([(i, w[1][k]) for i, w in have]).alias(f"hi{k}"))])
    rows = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), *[
        F.lit(float(wanted[i][2][k]) if wanted[i][2] else 0.0).alias(f"f{k}") for k in range(len(probs))]) for i, c in enumerate(cols)]
    names = df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return names.join(found, F.col("i") == F.col("ci"), "left").select("column_name", *[
        (F.col(f"lo{k}") + F.col(f"f{k}") * (F.col(f"hi{k}") - F.col(f"lo{k}"))).alias(f"q{k}") for k in range(len(probs))])


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null) for every column, one aggregation."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                     F.col(f"`{c}`").alias("non_null")) for c, t in df.dtypes]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def row_count(df: DataFrame) -> DataFrame:
    """P4 -> (n_rows)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def columns(df: DataFrame) -> list[tuple[str, str]]:
    """P5: column names and types, from the schema only (no rows read)."""
    return list(df.dtypes)


def date_bounds(df: DataFrame, col: str = "fl_date") -> DataFrame:
    """P6 -> (min_date, max_date)."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))
