"""Position stream: message building, validation, replay and restart."""

import uuid

from pyspark.sql import functions as F

from airmetrics import schemas
from airmetrics.session import scratch_path
from airmetrics.streaming import positions as pos


def _states(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, state array<string>")


def _vec(icao, callsign="CS1", last_contact="100", n=17):
    v = [icao, callsign, "C1", "99", last_contact, "1.5", "2.5", "300", "false", "250", "90", "-1",
         None, "350", "1234", "false", "0"]
    return v[:n]


def test_short_vectors_skipped_and_callsign_blank(spark):
    st = _states(spark, [_vec("a1", n=16), _vec("a2", callsign=None), _vec("a3")])
    m = pos.states_to_messages(st, None, keep=["seq"]).orderBy("seq").collect()
    assert [r.icao24 for r in m] == ["a2", "a3"]
    assert m[0].callsign == "" and m[0].altitude.geo == 300.0 and m[0].altitude.baro == 350.0


def test_enrich_last_flight_wins(spark):
    st = _states(spark, [_vec("a1"), _vec("a2")])
    fl = spark.createDataFrame([(1, "a1", 10, 20, "X", "K1"), (2, "a1", 11, 21, "Y", "K2")],
                               "seq long, icao24 string, firstSeen long, lastSeen long, "
                               "estDepartureAirport string, estArrivalAirport string")
    m = {r.icao24: r for r in pos.states_to_messages(st, fl).collect()}
    assert m["a1"].flight_info.estArrivalAirport == "K2" and m["a1"].flight_info.firstSeen == 11
    assert m["a2"].flight_info.firstSeen is None


def test_validation_rejects(spark):
    st = _states(spark, [_vec("a1"), _vec(None), _vec("a3", last_contact=None)])
    m = pos.states_to_messages(st)
    assert [r.icao24 for r in pos.valid_positions(m).collect()] == ["a1"]
    rej = sorted((r.icao24 or "", r.reject_reason) for r in pos.rejected_positions(m).collect())
    assert rej == [("", "missing icao24"), ("a3", "missing position.last_contact")]
    flat = pos.flatten_positions(pos.valid_positions(m)).collect()[0]
    assert flat.icao24 == "A1" and flat.velocity == 250.0 and flat.altitude_baro == 350.0


def test_stream_restart_no_loss_no_duplicates(spark):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    src = f"{base}/in"
    msgs = pos.states_to_messages(_states(spark, [_vec(f"a{i}", last_contact=str(100 + i)) for i in range(12)]))
    msgs.where("icao24 in ('a0','a1','a2','a3','a4','a5')").coalesce(2).write.json(f"{src}/part1")
    stream = spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", "1").json(f"{src}/*")
    q = pos.start_position_log(stream, f"{base}/sink", f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(f"{base}/sink").count() == 6
    msgs.where("icao24 not in ('a0','a1','a2','a3','a4','a5')").coalesce(1).write.json(f"{src}/part2")
    stream = spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", "1").json(f"{src}/*")
    q = pos.start_position_log(stream, f"{base}/sink", f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/sink")
    assert out.count() == 12 and out.select("icao24").distinct().count() == 12


def test_stream_equals_batch(spark):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    msgs = pos.states_to_messages(_states(spark, [_vec(f"a{i % 4}", last_contact=str(100 + i)) for i in range(20)]))
    src = pos.replay_folder(spark, msgs, base, parts=3)
    q = pos.start_position_log(pos.read_message_stream(spark, src, max_files=1), f"{base}/sink", f"{base}/ckpt",
                               trigger={"availableNow": True})
    q.awaitTermination()
    streamed = pos.active_by_country(spark.read.parquet(f"{base}/sink")).collect()
    batch = pos.active_by_country(pos.flatten_positions(pos.valid_positions(msgs))).collect()
    assert streamed == batch


def test_stream_count_by_country_complete_mode(spark):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    msgs = pos.states_to_messages(_states(spark, [_vec(f"a{i}") for i in range(5)]))
    src = pos.replay_folder(spark, msgs, base, parts=2)
    flat = pos.flatten_positions(pos.valid_positions(pos.read_message_stream(spark, src)))
    name = f"by_country_{uuid.uuid4().hex[:8]}"
    q = (pos.active_by_country(flat).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql(f"select * from {name}").collect()[0]["count"] == 5


def test_kafka_options():
    o = pos.kafka_source_options("host:9092", "flights")
    assert o["startingOffsets"] == "latest" and o["maxOffsetsPerTrigger"] == "100"
    assert F is not None
