"""Tables kept up to date by the position stream (T6, T7), and enrichment on the stream.

``start_live_counts`` and ``start_live_positions`` run a stateful aggregation in update mode: a batch hands on the running
values of the keys it changed, and these are put into a table in key buckets (``sources.buckets``), of which only the
touched buckets are rewritten. A value put twice is the same value, so a batch that is run again after a failure
changes nothing, and readers see the table before a batch or after it. State and table have one row per country or
aircraft. Reports without a country count under null; reports without an aircraft are no positions.

``start_enriched_log`` reads the flight list anew in every batch, so a list that was replaced holds from the next batch on
(last flight of an aircraft wins). A batch writes a folder of its own and replaces it when it is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from airmetrics.sources import buckets, versioned
from airmetrics.streaming import positions as pos

COUNTS = T.StructType().add("origin_country", T.StringType()).add("count", T.LongType())
LATEST = (T.StructType().add("icao24", T.StringType()).add("last_contact", T.LongType())
          .add("latitude", T.DoubleType()).add("longitude", T.DoubleType()))


def _start_table(rows: DataFrame, path: str, schema: T.StructType, key: str, n_buckets: int, checkpoint: str,
                 trigger: dict | None) -> StreamingQuery:
    spark = rows.sparkSession
    if versioned.token(spark, path) is None:
        buckets.create(spark.createDataFrame([], schema), path, [key], n_buckets)

    def put(batch: DataFrame, batch_id: int) -> None:
        buckets.upsert(batch.select(*schema.names), path, schema, [key])

    return (rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def start_live_counts(flat: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                      active_only: bool = False, n_buckets: int = 4) -> StreamingQuery:
    """Reports per origin country so far."""
    return _start_table(pos.active_by_country(flat, active_only), path, COUNTS, "origin_country", n_buckets, checkpoint, trigger)


def start_live_positions(flat: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, n_buckets: int = 16) -> StreamingQuery:
    """The latest position of every aircraft so far."""
    rows = pos.latest_positions(flat.where(F.col("icao24").isNotNull()))
    return _start_table(rows, path, LATEST, "icao24", n_buckets, checkpoint, trigger)


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    return buckets.table(spark, path, COUNTS)


def live_positions(spark: SparkSession, path: str) -> DataFrame:
    return buckets.table(spark, path, LATEST)


def start_enriched_log(states: DataFrame, flight_list: Callable[[], DataFrame | None], path: str, checkpoint: str,
                       trigger: dict | None = None, keep: list[str] | None = None) -> StreamingQuery:
    """State vectors as messages with the flight that the list names at the time of their batch, below ``path/batch=<id>``."""

    def enrich(batch: DataFrame, batch_id: int) -> None:
        pos.states_to_messages(batch, flight_list(), keep=keep).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (states.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())
