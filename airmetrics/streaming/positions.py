"""Aircraft position stream.

Every transformation is a plain DataFrame function, so the same code runs on a
batch frame and on a ``readStream`` frame. The stream job is
``readStream`` (Kafka or JSON files) -> ``from_json`` -> valid -> flatten ->
checkpointed append sink. Only the optional de-duplication keeps state, and it
is bounded by a watermark on the report time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from airmetrics import schemas
from airmetrics.operators.joins import bounded_broadcast, last_wins

MIN_STATE_LEN = 17
MAX_FLIGHT_LIST_ROWS = 2_000_000  # broadcast bound for the per-aircraft flight list


def _at(arr: Column, i: int) -> Column:
    """0-based positional access that yields null past the end."""
    return F.get(arr, i)


def latest_flights(flight_list: DataFrame, order: str = "seq") -> DataFrame:
    """J2 (right side): one flight per aircraft, the last in list order wins."""
    cols = ["firstSeen", "lastSeen", "estDepartureAirport", "estArrivalAirport"]
    return last_wins(flight_list.where(F.col("icao24").isNotNull()), "icao24", order, cols)


def enrich_states(states: DataFrame, flight_list: DataFrame | None, state_col: str = "state") -> DataFrame:
    """State vectors left-join the latest flight per aircraft on icao24.

    Vectors shorter than 17 values are skipped (T1). No match leaves the flight
    fields null (an empty ``flight_info``).
    """
    s = states.where(F.size(state_col) >= MIN_STATE_LEN).withColumn("icao24", _at(F.col(state_col), 0))
    if flight_list is None:
        for c in ["firstSeen", "lastSeen", "estDepartureAirport", "estArrivalAirport"]:
            s = s.withColumn(c, F.lit(None).cast(schemas.FLIGHT_INFO[c].dataType))
        return s
    right = bounded_broadcast(latest_flights(flight_list), MAX_FLIGHT_LIST_ROWS)
    return s.join(right, "icao24", "left")


def states_to_messages(states: DataFrame, flight_list: DataFrame | None = None,
                       state_col: str = "state", keep: list[str] | None = None) -> DataFrame:
    """Positional state vector -> nested message (schemas.MESSAGE).

    Index 7 is labelled ``geo`` and 13 ``baro`` (as the producer labels them;
    the public API documents the two the other way round). A null callsign
    becomes "" (blanks kept). Numbers that do not parse become null.
    """
    e = enrich_states(states, flight_list, state_col)
    a = F.col(state_col)

    def num(i, t="double"):
        return _at(a, i).try_cast(t)

    msg = [
        F.col("icao24"),
        F.coalesce(_at(a, 1), F.lit("")).alias("callsign"),
        _at(a, 2).alias("origin_country"),
        F.struct(num(3, "long").alias("timestamp"), num(4, "long").alias("last_contact"),
                 num(5).alias("longitude"), num(6).alias("latitude")).alias("position"),
        F.struct(num(7).alias("geo"), num(13).alias("baro")).alias("altitude"),
        F.struct(num(9).alias("velocity"), num(10).alias("heading"), num(11).alias("vertical_rate")).alias("movement"),
        F.struct(*[F.col(c) for c in ["firstSeen", "lastSeen", "estDepartureAirport", "estArrivalAirport"]])
         .alias("flight_info"),
    ]
    return e.select(*(keep or []), *msg)


def to_kafka_records(messages: DataFrame) -> DataFrame:
    """Keyed JSON records (key = icao24) for a Kafka sink."""
    return messages.select(F.col("icao24").alias("key"),
                           F.to_json(F.struct(*[F.col(c) for c in schemas.MESSAGE.fieldNames()]),
                                     {"ignoreNullFields": "false"}).alias("value"))


def parse_messages(records: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON text (Kafka value or file line) -> message struct columns."""
    return (records.select(F.from_json(F.col(value_col).cast("string"), schemas.MESSAGE).alias("m"))
            .select("m.*"))


def valid_condition() -> Column:
    return F.col("icao24").isNotNull() & F.col("position.last_contact").isNotNull()


def valid_positions(messages: DataFrame) -> DataFrame:
    """Keep messages with an aircraft id and a last-contact time."""
    return messages.where(valid_condition())


def rejected_positions(messages: DataFrame) -> DataFrame:
    """T2 (second sink): the rejected messages with a reason."""
    reason = (F.when(F.col("icao24").isNull(), F.lit("missing icao24"))
               .otherwise(F.lit("missing position.last_contact")))
    return messages.where(~F.coalesce(valid_condition(), F.lit(False))).withColumn("reject_reason", reason)


def flatten_positions(messages: DataFrame) -> DataFrame:
    """Nested message -> the 13-column flat position row (schemas.FLAT_POSITION)."""
    return messages.select(
        F.upper(F.col("icao24")).alias("icao24"),
        F.col("origin_country"),
        F.col("position.timestamp").try_cast("long").alias("time_position"),
        F.col("position.last_contact").try_cast("long").alias("last_contact"),
        F.col("position.latitude").try_cast("double").alias("latitude"),
        F.col("position.longitude").try_cast("double").alias("longitude"),
        F.col("altitude.geo").try_cast("double").alias("altitude_geo"),
        F.col("altitude.baro").try_cast("double").alias("altitude_baro"),
        F.col("movement.velocity").try_cast("double").alias("velocity"),
        F.col("movement.vertical_rate").try_cast("double").alias("vertical_rate"),
        F.col("flight_info.firstSeen").try_cast("long").alias("first_seen"),
        F.col("flight_info.lastSeen").try_cast("long").alias("last_seen"),
        F.col("flight_info.estArrivalAirport").alias("est_arrival_airport"),
    )


def dedup_reports(flat: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """T5 (optional): drop repeated (aircraft, last_contact) reports. On a stream
    the state is bounded by a watermark on the report time."""
    keyed = flat.withColumn("_event_time", F.timestamp_seconds(F.col("last_contact")))
    if flat.isStreaming:
        keyed = keyed.withWatermark("_event_time", watermark)
        out = keyed.dropDuplicatesWithinWatermark(["icao24", "last_contact"])
    else:
        out = keyed.dropDuplicates(["icao24", "last_contact"])
    return out.drop("_event_time")


def active_by_country(flat: DataFrame, active_only: bool = False) -> DataFrame:
    """Reports per origin country, ascending count. ``active_only`` keeps
    reports with no estimated arrival airport (the reference's filter is always
    true, so its default counts every report)."""
    src = flat.where(F.col("est_arrival_airport").isNull()) if active_only else flat
    g = src.groupBy("origin_country").agg(F.count(F.lit(1)).alias("count"))
    return g if flat.isStreaming else g.orderBy("count", "origin_country")


def positions(flat: DataFrame) -> DataFrame:
    """Current location projection."""
    return flat.select("icao24", "latitude", "longitude")


def latest_positions(flat: DataFrame) -> DataFrame:
    """The most recent report per aircraft (max_by on last_contact; equal
    times are broken by position so the answer is deterministic)."""
    order = F.struct("last_contact", "longitude", "latitude")
    return last_wins(flat.select("icao24", "last_contact", "latitude", "longitude"),
                     "icao24", order, ["last_contact", "latitude", "longitude"])


# ----------------------------------------------------------------------------- stream jobs

def kafka_source_options(bootstrap: str, topic: str, max_offsets: int = 100,
                         starting: str = "latest", fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of the Kafka source (start at latest, ~100 records per batch). Lost offsets
    end the query unless ``fail_on_data_loss`` is turned off."""
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic,
            "startingOffsets": starting, "maxOffsetsPerTrigger": str(max_offsets),
            "failOnDataLoss": str(fail_on_data_loss).lower()}


def kafka_sink_options(bootstrap: str, topic: str) -> dict[str, str]:
    """Options of the Kafka sink (records from ``to_kafka_records``)."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


def read_message_stream(spark: SparkSession, source: str, max_files: int | None = None,
                        kafka: dict[str, str] | None = None) -> DataFrame:
    """Message stream from Kafka (``kafka`` options) or from a folder of JSON
    files with the same schema (file source; one message per line)."""
    if kafka:
        return parse_messages(spark.readStream.format("kafka").options(**kafka).load())
    r = spark.readStream.schema(schemas.MESSAGE)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.json(source)


@dataclass(frozen=True)
class PositionLog:
    """The two queries of a position log with a reject sink. Each has its own checkpoint
    and reads the source by itself, so either can be restarted alone."""

    positions: StreamingQuery
    rejected: StreamingQuery

    def awaitTermination(self) -> None:
        self.positions.awaitTermination()
        self.rejected.awaitTermination()

    def stop(self) -> None:
        self.positions.stop()
        self.rejected.stop()


def start_position_log(messages: DataFrame, sink_path: str, checkpoint: str,
                       trigger: dict | None = None, dedup: bool = False,
                       rejected_path: str | None = None) -> StreamingQuery | PositionLog:
    """Valid -> flatten -> append to parquet, with a checkpoint.

    ``trigger`` defaults to ``processingTime='10 seconds'``; the batch size is set
    on the source (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``). With
    ``rejected_path`` the rejected messages go to a second sink with their reason, by a
    query of its own (checkpoint ``<checkpoint>-rejected``); the position sink has the
    same columns and the same ``dedup`` in both forms.
    """
    trigger = trigger or {"processingTime": "10 seconds"}

    def append(rows: DataFrame, path: str, state: str) -> StreamingQuery:
        return (rows.writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", state).trigger(**trigger).start(path))

    flat = flatten_positions(valid_positions(messages))
    log = append(dedup_reports(flat) if dedup else flat, sink_path, checkpoint)
    if rejected_path is None:
        return log
    return PositionLog(log, append(rejected_positions(messages), rejected_path, f"{checkpoint.rstrip('/')}-rejected"))


def replay_folder(spark: SparkSession, messages: DataFrame, base: str, parts: int = 4) -> str:
    """Write messages as JSON files into a fresh folder under ``base`` (test/replay input)."""
    path = f"{base.rstrip('/')}/messages-{uuid.uuid4().hex}"
    messages.repartition(parts).write.json(path)
    return path
