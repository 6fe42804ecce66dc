"""File sources and sinks.

Parquet is the store. The flights fact table is written partitioned by month
(``fl_month``), so a date-window query prunes whole folders before reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.operators.modelling import canonical_names
from airmetrics.schemas import RAW_CSV


def read_flights_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     extra_columns: list[str] | None = None) -> DataFrame:
    """Every CSV file under ``path`` (a folder or glob) as one table.

    All columns are read as text with an explicit schema (no inference pass over
    100 TB); malformed lines are kept with nulls (PERMISSIVE). Conversion is
    done afterwards by the native cleaning expressions.

    Without ``schema`` the columns are taken by name from the header of the file set (one
    line is read for it): source or canonical names, in any order, among any others. The
    result has the canonical columns, the record key and tail number where present, and
    ``extra_columns``. A file whose header differs from the others' fails the read instead
    of shifting columns; read sets of different layout one by one and union them by name.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    header = spark.read.option("header", True).csv(path).columns
    rows = canonical_names(reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path))
    have = {c.upper(): c for c in rows.columns}
    keep = [f"`{have[c]}`" for c in RAW_CSV.names if c in have]
    return rows.select(*keep, *[f"`{c}`" for c in extra_columns or []])


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite", compression: str = "none") -> None:
    """CSV with a header and no index column. ``single`` writes one file:
    the query still runs in parallel and only the last step (one shuffle into one
    partition, then the write) is a single task, so keep it for small results
    such as a query download. ``compression`` (as Spark's CSV option, e.g. gzip) keeps wide text
    small; each file is then read by one task, so use it with one file per write task."""
    out = df.repartition(1) if single else df
    out.write.mode(mode).option("header", True).option("compression", compression).csv(path)


def with_month(flights: DataFrame) -> DataFrame:
    """Partition column for the stored fact table: 'yyyy-MM' of fl_date."""
    return flights.withColumn("fl_month", F.coalesce(F.date_format("fl_date", "yyyy-MM"), F.lit("unknown")))


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append cleaned rows to a parquet table (fact: partitioned by month). Rows are
    rebalanced by the partition columns first, so a load does not write tasks x months files."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def write_flights(flights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the fact table partitioned by month.

    The REBALANCE hint lets AQE size the write tasks at runtime: a month holding
    a large share of the rows is split over several tasks, small months are
    merged, and no extra sampling pass over the input is needed (as a range
    repartition would). Rows are sorted by month and key inside each task, so a
    task writes one file per month it holds.
    """
    m = with_month(flights)
    (m.hint("rebalance", "fl_month").sortWithinPartitions("fl_month", "flight_id")
      .write.mode(mode).partitionBy("fl_month").parquet(path))


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_records(df: DataFrame) -> DataFrame:
    """Rows as JSON objects (one string column ``record``); null columns keep their key."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("record"))


def stored_months(spark: SparkSession, path: str) -> list[str]:
    """The months ('yyyy-MM') of a month-partitioned table, from its folders."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/fl_month=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [s.getPath().getName().split("=", 1)[1] for s in found]
    return sorted(m for m in names if m not in ("unknown", "__HIVE_DEFAULT_PARTITION__"))


def stored_bounds(spark: SparkSession, path: str) -> tuple:
    """First and last day of a table stored by ``write_flights``. Only the dates of its first and last month are
    read, whatever the table's size; months without rows are passed over. An empty table gives (None, None)."""
    months = stored_months(spark, path)

    def read(names: list[str]):
        rows = spark.read.schema("fl_date date").parquet(*[f"{path.rstrip('/')}/fl_month={m}" for m in names])
        return rows.agg(F.min("fl_date"), F.max("fl_date")).first()

    while months:
        lo, hi = read(sorted({months[0], months[-1]}))
        seen = {f"{d:%Y-%m}" for d in (lo, hi) if d is not None}
        if seen == {months[0], months[-1]}:
            return lo, hi
        months = [m for m in months if m in seen or m not in (months[0], months[-1])]
    return None, None
