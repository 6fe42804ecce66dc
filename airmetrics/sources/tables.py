"""Table maintenance: database reads, upsert, incremental append.

No JDBC driver jar ships with this package; ``jdbc_read_options`` builds the
options of a range-partitioned read and ``read_table`` uses them when a driver
is on the classpath. Parquet is the default store.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airmetrics.operators.joins import last_wins
from airmetrics.session import scratch_path


def jdbc_read_options(url: str, table: str, partition_column: str | None = None,
                      lower: int | None = None, upper: int | None = None, partitions: int = 10,
                      fetch_size: int = 10000, user: str | None = None, password: str | None = None,
                      driver: str | None = None) -> dict[str, str]:
    """S3: options of a JDBC scan split into ``partitions`` ranges of a numeric key.
    Credentials are passed in by the caller, never stored here."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(partitions)})
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    return opts


def read_table(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """S3: a parquet path, or a JDBC table given by ``jdbc_read_options``."""
    if isinstance(source, dict):
        return spark.read.format("jdbc").options(**source).load()
    return spark.read.parquet(source)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str],
           order: Column | str | None = None) -> DataFrame:
    """Insert or replace rows by primary key.

    Updates are reduced to one row per key first (``order`` picks the latest;
    without it the largest row wins, deterministically), then target rows whose
    key is updated are removed with an anti join and the updates are added.
    """
    value_cols = [c for c in updates.columns if c not in keys]
    order_col = order if order is not None else F.struct(*[F.col(c) for c in value_cols])
    latest = last_wins(updates, keys, order_col, value_cols).select(*target.columns)
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest)


def upsert_to_new_path(spark: SparkSession, target: DataFrame, updates: DataFrame, keys: list[str],
                       base: str, order: Column | str | None = None) -> str:
    """S5 with storage: write the merged table to a fresh folder and return it.
    The caller swaps its table pointer; the old folder is never overwritten
    while it is being read."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    upsert(target, updates, keys, order).write.parquet(path)
    return path


def default_rules() -> list[tuple[str, Column, str]]:
    """Validation rules of the incremental copy; the first failing rule names the error."""
    return [
        ("fl_date", F.col("fl_date").isNotNull(), "fl_date missing or unparseable"),
        ("op_carrier", F.col("op_carrier").isNotNull(), "op_carrier missing"),
        ("airports", F.col("origin_airport_id").isNotNull() & F.col("dest_airport_id").isNotNull(),
         "airport id missing"),
        ("crs_dep_time", F.col("crs_dep_time").isNotNull(), "crs_dep_time missing or invalid"),
    ]


def not_loaded(src: DataFrame, loaded: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The rows of ``src`` that no earlier load took (``loaded``: its valid and rejected rows).

    Without ``key`` whole records are compared as a multiset: a record that ``src`` holds n
    times and ``loaded`` m times comes out n - m times. Both sides are counted with map-side
    partial aggregation, so a record that fills a third of the table is no hot key. ``key``
    names the columns of a key that is truly unique; rows are then compared by it alone.
    """
    if key is None:
        return src.exceptAll(loaded.select(*src.columns))
    seen = loaded.select(*[F.col(c).alias(f"_seen_{c}") for c in key]).distinct()
    same = reduce(lambda a, b: a & b, [src[c].eqNullSafe(F.col(f"_seen_{c}")) for c in key])
    return src.join(seen, same, "left_anti")


def incremental_append(src: DataFrame, high_water=None, key: str = "flight_id", rules=None,
                       loaded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows after the stopping point, split into (valid, rejected).

    The stopping point is ``loaded`` (what earlier loads took, see ``not_loaded``), or
    ``high_water`` where ``key`` grows with every load. A hashed key does not: a new row's
    hash may lie below the mark, so records without a key of their own need ``loaded``.
    ``rejected`` carries an ``error`` text (first failing rule). Both frames come
    from one projection; each batch is retried by Spark as a whole task, so a
    failed worker neither loses nor duplicates rows.
    """
    rules = rules or default_rules()
    new = src if high_water is None else src.where(F.col(key) > F.lit(high_water))
    if loaded is not None:
        new = not_loaded(new, loaded)
    err = F.lit(None).cast("string")
    for _, ok, text in reversed(rules):
        err = F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)).otherwise(err)
    tagged = new.withColumn("error", err)
    return tagged.where(F.col("error").isNull()).drop("error"), tagged.where(F.col("error").isNotNull())


def high_water_mark(table: DataFrame, key: str = "flight_id"):
    """The largest key already loaded (one scalar)."""
    return table.agg(F.max(key)).first()[0]


def with_unique_id(df: DataFrame, after: int = 0, column: str = "flight_id") -> DataFrame:
    """C13 for records without a key of their own: ``column`` numbers the rows after + 1 ... after + n.

    The rows are written once below the shared checkpoint folder with their task and place
    in it, so the numbers do not change when a later job is retried. Each task's rows then
    follow those of the tasks before it. No sort, no shuffle of rows, no hot key; the table of
    task sizes has one row per write task. Start the next load after ``high_water_mark``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex}")
    placed = df.withColumn("_place", F.monotonically_increasing_id())  # task << 33 | row in the task
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_task", F.shiftright("_place", 33))
    sizes = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    number = F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(after + 1)
    # the sizes are left to the planner: AQE broadcasts them where their measured size is small
    return rows.join(first, "_task").withColumn(column, number.cast("long")).drop("_place", "_task", "_first")
