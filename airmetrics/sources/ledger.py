"""Incremental loads with a ledger.

Every load writes its rows below ``<path>/rows`` in a partition of its own, (source, load_id), valid
and rejected ones together with the error text, and then one line to ``<path>/ledger``: load id, source, rows
read, rows compared with, new rows, valid and rejected ones. Only loads with a line count: readers skip the others.

* A source that no load took before is appended without any comparison. A source that comes again
  is compared, as a multiset, with the rows of that source alone (partition pruning), so what load k reads
  does not grow with the history.
* The line is written last. A load that dies before leaves rows without a line; the next load of
  any source takes the same id, and ``discard`` removes what that id left before it writes.
* Numbers of valid rows (``flight_id``) follow those of all earlier loads, taken from the ledger's counts.

One writer at a time: two loads at once would take the same id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airmetrics.session import stored
from airmetrics.sources.tables import default_rules, not_loaded, with_unique_id

LEDGER = "load_id long, source string, n_read long, n_compared long, n_new long, n_valid long, n_rejected long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished load."""
    at = f"{path}/ledger"
    return spark.read.schema(LEDGER).parquet(at) if _exists(spark, at) else spark.createDataFrame([], LEDGER)


def loaded(spark: SparkSession, path: str, columns: StructType, source: str | None = None) -> DataFrame:
    """The rows of all finished loads (of one source): ``columns``, flight_id (null where rejected), error, source, load_id."""
    lines = ledger(spark, path) if source is None else ledger(spark, path).where(F.col("source") == source)
    done = [r["load_id"] for r in lines.where("n_new > 0").select("load_id").collect()]  # one number per load
    schema = StructType([f for f in columns.fields if f.name != "flight_id"]).add("flight_id", "long").add("error", "string").add("source", "string").add("load_id", "long")
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("load_id").isin(done))
    return rows if source is None else rows.where(F.col("source") == source)


def discard(spark: SparkSession, path: str, load_id: int) -> None:
    """Remove the rows of a load that has no line in the ledger, from whatever source it was."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/source=*/load_id={load_id}")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)


def load(src: DataFrame, source: str, path: str, rules=None, before_line: Callable[[], None] | None = None) -> Row:
    """Load ``src`` (records without a key of their own) as a delivery of ``source``; returns its ledger line.

    ``before_line`` runs between the rows and the line (tests stop a load there).
    """
    spark = src.sparkSession
    lines = ledger(spark, path).agg(F.max("load_id").alias("last"), F.sum("n_valid").alias("valid"),
                                    F.sum(F.when(F.col("source") == source, F.col("n_new"))).alias("own")).first()
    load_id, compared = (lines["last"] or 0) + 1, lines["own"] or 0
    discard(spark, path, load_id)
    rows = src.drop("flight_id")
    # a new source has nothing to be compared with
    new = not_loaded(rows, loaded(spark, path, src.schema, source)) if compared else rows
    error = F.lit(None).cast("string")
    for _, ok, text in reversed(rules or default_rules()):
        error = F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)).otherwise(error)
    tagged = stored(new.withColumn("error", error), "load")
    good = with_unique_id(tagged.where("error is null"), lines["valid"] or 0)
    bad = tagged.where("error is not null").withColumn("flight_id", F.lit(None).cast("long"))
    out = good.unionByName(bad).withColumn("source", F.lit(source)).withColumn("load_id", F.lit(load_id).cast("long"))
    out.write.mode("append").partitionBy("source", "load_id").parquet(f"{path}/rows")
    counts = tagged.agg(F.count("*").alias("new"), F.count("error").alias("bad")).first()
    if before_line is not None:
        before_line()
    # without a comparison every row read is new: the source is not read again to count it
    read = src.count() if compared else counts["new"]
    line = spark.createDataFrame([(load_id, source, read, compared, counts["new"], counts["new"] - counts["bad"], counts["bad"])], LEDGER)
    line.repartition(1).write.mode("append").parquet(f"{path}/ledger")
    return line.first()
