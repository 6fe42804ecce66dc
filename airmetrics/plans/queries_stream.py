"""Catalog entries for the position stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airmetrics import schemas
from airmetrics.plans.catalog import register
from airmetrics.session import scratch_path
from airmetrics.sources import fixtures as fx
from airmetrics.streaming import live
from airmetrics.streaming import positions as pos

EVENT_CTES = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events),
sv AS (
  SELECT event_id AS seq, 'a' || CAST(user_id AS VARCHAR) AS icao24,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'CS' || CAST(event_id % 900 AS VARCHAR) END AS callsign,
    'C' || CAST(user_id % 12 AS VARCHAR) AS origin_country,
    ep AS pos_timestamp,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE ep END AS last_contact,
    CAST(event_id % 360 - 180 AS DOUBLE) AS longitude,
    CAST(user_id % 180 - 90 AS DOUBLE) AS latitude,
    value * 10 AS alt_geo, value * 10 + 50 AS alt_baro,
    CASE WHEN event_id % 50 = 7 THEN NULL ELSE value END AS velocity,
    CAST(event_id % 360 AS DOUBLE) AS heading,
    value - 20 AS vertical_rate
  FROM ev WHERE event_id % 97 <> 3
),
fl AS (
  SELECT icao24, first_seen, last_seen, est_departure_airport, est_arrival_airport FROM (
    SELECT 'a' || CAST(user_id AS VARCHAR) AS icao24, ep AS first_seen, ep + 3600 AS last_seen,
      'D' || CAST(user_id % 5 AS VARCHAR) AS est_departure_airport,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'K' || CAST(user_id % 7 AS VARCHAR) END AS est_arrival_airport,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
    FROM ev WHERE event_type = 'signup') t WHERE rn = 1
),
msg AS (SELECT sv.*, fl.first_seen, fl.last_seen, fl.est_departure_airport, fl.est_arrival_airport
        FROM sv LEFT JOIN fl USING (icao24)),
flat AS (
  SELECT upper(icao24) AS icao24, origin_country, pos_timestamp AS time_position, last_contact, latitude, longitude,
         alt_geo AS altitude_geo, alt_baro AS altitude_baro, velocity, vertical_rate, first_seen, last_seen,
         est_arrival_airport
  FROM msg WHERE last_contact IS NOT NULL
)"""


def ev_sql(body: str) -> str:
    return f"WITH {EVENT_CTES}\n{body}"


FLAT_COLS = ", ".join(schemas.FLAT_POSITION.fieldNames())


def messages(spark, sf_dir):
    return pos.states_to_messages(fx.state_vectors(spark, sf_dir), fx.flight_list(spark, sf_dir), keep=["seq"])


def flat(spark, sf_dir):
    return pos.flatten_positions(pos.valid_positions(messages(spark, sf_dir)))


def _flat_message(df):
    return df.select(
        "seq", "icao24", "callsign", "origin_country",
        F.col("position.timestamp").alias("pos_timestamp"), F.col("position.last_contact").alias("last_contact"),
        F.col("position.longitude").alias("longitude"), F.col("position.latitude").alias("latitude"),
        F.col("altitude.geo").alias("alt_geo"), F.col("altitude.baro").alias("alt_baro"),
        F.col("movement.velocity").alias("velocity"), F.col("movement.heading").alias("heading"),
        F.col("movement.vertical_rate").alias("vertical_rate"))


@register("states_to_messages", ev_sql("""
SELECT seq, icao24, callsign, origin_country, pos_timestamp, last_contact, longitude, latitude,
       alt_geo, alt_baro, velocity, heading, vertical_rate FROM sv"""))
def q_states_to_messages(spark, sf_dir):
    return _flat_message(pos.states_to_messages(fx.state_vectors(spark, sf_dir), None, keep=["seq"]))


@register("enrich_states", ev_sql("""
SELECT seq, icao24, first_seen, last_seen, est_departure_airport, est_arrival_airport FROM msg"""))
def q_enrich_states(spark, sf_dir):
    e = pos.enrich_states(fx.state_vectors(spark, sf_dir), fx.flight_list(spark, sf_dir))
    return e.select("seq", "icao24", F.col("firstSeen").alias("first_seen"), F.col("lastSeen").alias("last_seen"),
                    F.col("estDepartureAirport").alias("est_departure_airport"),
                    F.col("estArrivalAirport").alias("est_arrival_airport"))


@register("position_messages", ev_sql("""
SELECT icao24 AS key, icao24, callsign, origin_country, pos_timestamp, last_contact, longitude, latitude,
       alt_geo, alt_baro, velocity, heading, vertical_rate, first_seen, last_seen,
       est_departure_airport, est_arrival_airport FROM msg"""))
def q_position_messages(spark, sf_dir):
    """Keyed JSON records; checked by parsing the JSON value back."""
    rec = pos.to_kafka_records(messages(spark, sf_dir))
    m = rec.select("key", F.from_json("value", schemas.MESSAGE).alias("m")).select("key", "m.*")
    return m.select(
        "key", "icao24", "callsign", "origin_country",
        F.col("position.timestamp").alias("pos_timestamp"), F.col("position.last_contact").alias("last_contact"),
        F.col("position.longitude").alias("longitude"), F.col("position.latitude").alias("latitude"),
        F.col("altitude.geo").alias("alt_geo"), F.col("altitude.baro").alias("alt_baro"),
        F.col("movement.velocity").alias("velocity"), F.col("movement.heading").alias("heading"),
        F.col("movement.vertical_rate").alias("vertical_rate"),
        F.col("flight_info.firstSeen").alias("first_seen"), F.col("flight_info.lastSeen").alias("last_seen"),
        F.col("flight_info.estDepartureAirport").alias("est_departure_airport"),
        F.col("flight_info.estArrivalAirport").alias("est_arrival_airport"))


@register("valid_positions", ev_sql("SELECT seq, icao24, last_contact FROM msg WHERE last_contact IS NOT NULL"))
def q_valid_positions(spark, sf_dir):
    v = pos.valid_positions(messages(spark, sf_dir))
    return v.select("seq", "icao24", F.col("position.last_contact").alias("last_contact"))


@register("rejected_positions", ev_sql("""
SELECT seq, icao24, 'missing position.last_contact' AS reject_reason FROM msg WHERE last_contact IS NULL"""))
def q_rejected_positions(spark, sf_dir):
    return pos.rejected_positions(messages(spark, sf_dir)).select("seq", "icao24", "reject_reason")


@register("flatten_positions", ev_sql(f"SELECT {FLAT_COLS} FROM flat"))
def q_flatten_positions(spark, sf_dir):
    return flat(spark, sf_dir)


def _replay(spark, sf_dir, dedup: bool):
    base = scratch_path(spark, f"stream-replay-{uuid.uuid4().hex}")
    src = pos.replay_folder(spark, messages(spark, sf_dir).drop("seq"), base, parts=4)
    # With dedup all files go in one trigger: the replay folder is not in time
    # order, and rows older than the watermark would count as late data.
    stream = pos.read_message_stream(spark, src, max_files=None if dedup else 1)
    q = pos.start_position_log(stream, f"{base}/sink", f"{base}/checkpoint",
                               trigger={"availableNow": True}, dedup=dedup)
    q.awaitTermination()
    return spark.read.schema(schemas.FLAT_POSITION).parquet(f"{base}/sink")


@register("stream_replay", ev_sql(f"SELECT {FLAT_COLS} FROM flat"))
def q_stream_replay(spark, sf_dir):
    return _replay(spark, sf_dir, dedup=False)


@register("stream_dedup_replay", ev_sql("SELECT DISTINCT icao24, last_contact FROM flat"))
def q_stream_dedup_replay(spark, sf_dir):
    return _replay(spark, sf_dir, dedup=True).select("icao24", "last_contact")


@register("active_by_country", ev_sql("""
SELECT origin_country, count(*) AS count FROM flat GROUP BY origin_country"""))
def q_active_by_country(spark, sf_dir):
    return pos.active_by_country(flat(spark, sf_dir))


@register("active_by_country_strict", ev_sql("""
SELECT origin_country, count(*) AS count FROM flat WHERE est_arrival_airport IS NULL GROUP BY origin_country"""))
def q_active_by_country_strict(spark, sf_dir):
    return pos.active_by_country(flat(spark, sf_dir), active_only=True)


@register("positions", ev_sql("SELECT icao24, latitude, longitude FROM flat"))
def q_positions(spark, sf_dir):
    return pos.positions(flat(spark, sf_dir))


@register("latest_positions", ev_sql("""
SELECT icao24, last_contact, latitude, longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY last_contact DESC, longitude DESC, latitude DESC) AS rn
  FROM flat) t WHERE rn = 1"""))
def q_latest_positions(spark, sf_dir):
    return pos.latest_positions(flat(spark, sf_dir))


def _live(spark, sf_dir, start):
    """The replay in four triggers, the last two after a restart; returns the table's path."""
    base = scratch_path(spark, f"live-{uuid.uuid4().hex}")
    rows = messages(spark, sf_dir)
    for half in (0, 1):
        rows.where(F.col("seq") % 2 == half).drop("seq").repartition(2).write.mode("append").json(f"{base}/in")
        stream = pos.read_message_stream(spark, f"{base}/in", max_files=1)
        start(pos.flatten_positions(pos.valid_positions(stream)), f"{base}/table", f"{base}/state", {"availableNow": True}).awaitTermination()
    return f"{base}/table"


@register("live_counts", ev_sql("SELECT origin_country, count(*) AS count FROM flat GROUP BY origin_country"))
def q_live_counts(spark, sf_dir):
    """T6 as a table that the stream keeps up to date."""
    return live.live_counts(spark, _live(spark, sf_dir, live.start_live_counts))


@register("live_positions", ev_sql("""
SELECT icao24, last_contact, latitude, longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY last_contact DESC, longitude DESC, latitude DESC) AS rn
  FROM flat WHERE icao24 IS NOT NULL) t WHERE rn = 1"""))
def q_live_positions(spark, sf_dir):
    """T7 as a table that the stream keeps up to date."""
    return live.live_positions(spark, _live(spark, sf_dir, live.start_live_positions))


@register("stream_enriched", ev_sql("""
, lists AS (
  SELECT * FROM (
    SELECT k, 'a' || CAST(user_id AS VARCHAR) AS icao24, ep AS first_seen, ep + 3600 AS last_seen,
      'D' || CAST(user_id % 5 AS VARCHAR) AS est_departure_airport,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'K' || CAST(user_id % 7 AS VARCHAR) END AS est_arrival_airport,
      row_number() OVER (PARTITION BY k, user_id ORDER BY event_id DESC) AS rn
    FROM ev, (VALUES (0), (1), (2), (3)) b(k) WHERE event_type = 'signup' AND event_id % 4 <= k) t WHERE rn = 1)
SELECT seq, sv.icao24, seq % 4 AS batch, first_seen, last_seen, est_departure_airport, est_arrival_airport
FROM sv LEFT JOIN lists ON sv.icao24 = lists.icao24 AND lists.k = seq % 4""").replace("\n\n, lists", ",\nlists"))
def q_stream_enriched(spark, sf_dir):
    """J2 on the stream: four triggers, each with more of the flight list than the one before."""
    base = scratch_path(spark, f"enriched-{uuid.uuid4().hex}")
    states, flights = fx.state_vectors(spark, sf_dir), fx.flight_list(spark, sf_dir)
    for k in range(4):
        states.where(F.col("seq") % 4 == k).write.mode("append").parquet(f"{base}/in")
        flights.where(F.col("seq") % 4 <= k).write.mode("overwrite").parquet(f"{base}/list")
        stream = spark.readStream.schema(states.schema).parquet(f"{base}/in")
        live.start_enriched_log(stream, lambda: spark.read.schema(flights.schema).parquet(f"{base}/list"), f"{base}/log", f"{base}/state",
                                {"availableNow": True}, keep=["seq"]).awaitTermination()
    return spark.read.parquet(f"{base}/log").select(
        "seq", "icao24", F.col("batch").cast("long").alias("batch"), F.col("flight_info.firstSeen").alias("first_seen"),
        F.col("flight_info.lastSeen").alias("last_seen"), F.col("flight_info.estDepartureAirport").alias("est_departure_airport"),
        F.col("flight_info.estArrivalAirport").alias("est_arrival_airport"))
