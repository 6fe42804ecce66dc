"""A table in key buckets, where an upsert rewrites only the buckets it touches.

A row lies in bucket ``xxhash64(keys) mod buckets`` of a table of parts (``versioned``). An upsert reduces the updates to
one row a key, reads the buckets that hold their keys, replaces or inserts the rows there and stores those
buckets as a new version; all other files stay as they are, and a reader sees either the state before or after. The join
runs within buckets of about rows / buckets rows whatever the table's size; with the updates spread over all
buckets the whole table is rewritten, as without buckets.

Null keys are keys like any other (null equals null). Columns of the updates in another order are taken by name; one that
the table lacks is ignored, one that it has and they lack is an error. ``part`` and ``version`` cannot be column names. The number of buckets is fixed when the table is created (``create``) and found again from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airmetrics.operators.joins import last_wins
from airmetrics.session import cut_lineage
from airmetrics.sources import versioned

_HERE = "_part"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("string")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Store ``rows`` (unique by ``keys``) as a new bucketed table."""
    if {"part", "version"} & {c.lower() for c in rows.columns}:
        raise ValueError("part and version are columns of the storage")
    versioned.write(rows.withColumn("part", _bucket(keys, buckets)), path, token=str(buckets))


def table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as it is now."""
    return versioned.read(spark, path, schema).drop("part")


def lookup(spark: SparkSession, path: str, schema: StructType, key: dict) -> DataFrame:
    """The row of one key, from its bucket alone."""
    buckets = int(versioned.token(spark, path))
    typed = spark.range(1).select(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in key.items()])
    part = typed.select(_bucket(list(key), buckets)).first()[0]
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in key.items()])
    return versioned.read(spark, path, schema, [part]).drop("part").where(same)


def upsert(updates: DataFrame, path: str, schema: StructType, keys: list[str], order: Column | str | None = None) -> list[str]:
    """Insert or replace rows by key; returns the buckets that were rewritten.

    Several updates of a key: ``order`` picks the latest, without it the largest row wins.
    """
    spark = updates.sparkSession
    buckets = int(versioned.token(spark, path))
    values = [c for c in schema.names if c not in keys]
    typed = updates.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields],
                           *([] if order is None else [(F.expr(order) if isinstance(order, str) else order).alias("_order")]))
    rank = F.struct(*([] if order is None else ["_order"]), *[F.col(f"`{c}`") for c in values])  # never null: a null order is the smallest
    latest = last_wins(typed, keys, rank, values) if values else typed.select(*keys).distinct()
    latest = cut_lineage(latest.select(*schema.names).withColumn("part", _bucket(keys, buckets)))  # read three times below
    touched = [r["part"] for r in latest.select("part").distinct().collect()]  # at most the number of buckets
    if not touched:
        return []
    old = versioned.read(spark, path, schema, touched).withColumnRenamed("part", _HERE)
    new = latest.select(F.col("part").alias("_p"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [old[f"`{k}`"].eqNullSafe(new[f"_k{i}"]) for i, k in enumerate(keys)])
    kept = old.join(new, (old[_HERE] == new["_p"]) & same, "left_anti").withColumnRenamed(_HERE, "part")
    versioned.write(kept.unionByName(latest), path, token=str(buckets), touched=touched)
    return sorted(touched)
