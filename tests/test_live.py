"""Tables kept up to date by the stream, against the batch result."""

from airmetrics import schemas
from airmetrics.streaming import live
from airmetrics.streaming import positions as pos
from tests.test_stream import _states, _vec


def _run(spark, start, base, name):
    stream = spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", "1").json(f"{base}/in")
    start(pos.flatten_positions(pos.valid_positions(stream)), f"{base}/{name}", f"{base}/{name}-state", {"availableNow": True}).awaitTermination()


def test_live_tables_over_triggers_and_a_batch_run_again(spark, tmp_path):
    base = str(tmp_path)
    rows = [_vec(f"a{i % 7}", last_contact=str(100 + i * 13 % 40)) for i in range(30)]
    for i, r in enumerate(rows):
        r[2], r[5] = (None if i % 10 == 0 else f"C{i % 3}"), str(i)
    msgs = pos.states_to_messages(_states(spark, rows), keep=["seq"])
    for part in range(3):
        msgs.where(f"seq % 3 = {part}").drop("seq").repartition(2).write.mode("append").json(f"{base}/in")
        _run(spark, live.start_live_counts, base, "counts")
        _run(spark, live.start_live_positions, base, "latest")
        flat = pos.flatten_positions(pos.valid_positions(msgs.where(f"seq % 3 <= {part}").drop("seq")))
        assert {tuple(r) for r in live.live_counts(spark, f"{base}/counts").collect()} == {tuple(r) for r in pos.active_by_country(flat).collect()}
        got = live.live_positions(spark, f"{base}/latest")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in pos.latest_positions(flat).select(got.columns).collect()}
    # the last batch's commit is lost: it runs again and the table stays as it is
    before = sorted(map(tuple, live.live_counts(spark, f"{base}/counts").collect()), key=repr)
    last = max((tmp_path / "counts-state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    _run(spark, live.start_live_counts, base, "counts")
    assert sorted(map(tuple, live.live_counts(spark, f"{base}/counts").collect()), key=repr) == before


def test_flight_list_is_read_anew(spark, tmp_path):
    base = str(tmp_path)
    states = _states(spark, [_vec("a1"), _vec("a2")])
    lists = "seq long, icao24 string, firstSeen long, lastSeen long, estDepartureAirport string, estArrivalAirport string"
    found = []
    for k, flights in enumerate([None, [(1, "a1", 1, 2, "X", "K1")], [(1, "a1", 1, 2, "X", "K1"), (2, "a1", 3, 4, "Y", "K2")]]):
        states.coalesce(1).write.mode("append").parquet(f"{base}/in")
        now = None if flights is None else spark.createDataFrame(flights, lists)
        stream = spark.readStream.schema(states.schema).parquet(f"{base}/in")
        live.start_enriched_log(stream, lambda now=now: now, f"{base}/log", f"{base}/state", {"availableNow": True}).awaitTermination()
        rows = spark.read.parquet(f"{base}/log").where(f"batch = {k}").collect()
        found.append({r["icao24"]: r["flight_info"]["estArrivalAirport"] for r in rows})
    assert found == [{"a1": None, "a2": None}, {"a1": "K1", "a2": None}, {"a1": "K2", "a2": None}]
