"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage for good: later jobs, retries after a lost executor included, read
    the written files. The schema is passed on, so no job infers it.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node.

    Alternating star contraction: every round links each node's larger neighbours to its
    smallest neighbour (large star), then its smaller ones (small star). All rounds are
    joins and minima on Spark, with the edge list written between rounds; nothing but a
    row count and a checksum reaches the driver. Nodes without an edge are not returned.
    """
    e = stored(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least2.select("a", F.col("m").alias("b")))).distinct()
        e = stored(small, "edges")
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().join(
        e.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
