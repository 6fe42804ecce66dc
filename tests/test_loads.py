"""Loads that lose nothing, unique numbers, the reader by name, and the log with two sinks."""

import uuid

import pytest
from pyspark.sql import functions as F

from airmetrics import schemas
from airmetrics.functions.clean import parse_fl_date
from airmetrics.operators.modelling import build_flights
from airmetrics.session import scratch_path
from airmetrics.sources import files
from airmetrics.sources import tables as tbl
from airmetrics.streaming import positions as pos


def _fresh(spark):
    return scratch_path(spark, f"t-{uuid.uuid4().hex}")


def test_not_loaded_counts_repeated_records_and_nulls(spark):
    src = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "b"), (3, "c")], "k int, v string")
    loaded = spark.createDataFrame([("x", None, 1), ("y", "b", 2)], "extra string, v string, k int")
    assert sorted(map(str, tbl.not_loaded(src, loaded).collect())) == sorted(
        map(str, src.where("k <> 2").limit(0).union(spark.createDataFrame([(1, None), (1, None), (3, "c")], "k int, v string")).collect()))
    assert [r.k for r in tbl.not_loaded(src, loaded, key=["k"]).collect()] == [3]
    assert tbl.not_loaded(src.limit(0), loaded).count() == 0


def test_unique_ids_are_dense_over_two_loads(spark):
    first = tbl.with_unique_id(spark.range(1000, numPartitions=7).selectExpr("1 AS same"))
    second = tbl.with_unique_id(spark.range(10, numPartitions=3).selectExpr("1 AS same"), after=1000)
    ids = [r.flight_id for r in first.union(second).select("flight_id").collect()]
    assert sorted(ids) == list(range(1, 1011))
    assert tbl.with_unique_id(spark.range(0)).count() == 0


def test_reader_takes_source_names_in_any_order(spark):
    names = [*reversed(list(schemas.SOURCE_TO_CANONICAL)), "Year", "Div1Airport"]
    values = {"FlightDate": "2018-03-04", "Origin": "JFK", "CRSDepTime": "0930", "Tail_Number": "N1"}
    path = _fresh(spark)
    row = spark.createDataFrame([tuple(values.get(n, "1") for n in names)], ", ".join(f"`{n}` string" for n in names))
    files.write_csv(row, path)
    back = files.read_flights_csv(spark, path, extra_columns=["Year"])
    assert set(back.columns) == {*schemas.CANONICAL_COLUMNS, "TAIL_NUM", "Year"}
    got = build_flights(back.drop("Year")).first()
    assert str(got.fl_date) == "2018-03-04" and got.crs_dep_time == 34200 and got.tail_num == "N1"


def test_reader_refuses_files_without_a_kept_column(spark):
    path = _fresh(spark)
    files.write_csv(spark.range(1), path)
    with pytest.raises(ValueError):
        files.read_flights_csv(spark, path)


def test_more_date_layouts(spark):
    cases = {"2018/03/04": "2018-03-04", "2018-03-04 10:00": "2018-03-04", "2018-03-04 00:00:00.000": "2018-03-04",
             "2018-03-04T10:00:00Z": "2018-03-04", "2018-03-04T10:00:00+02:00": "2018-03-04", "Mar 4, 2018": "2018-03-04",
             "3/4/18": "2018-03-04", "12/31/99": "1999-12-31", "13/04/2018": "2018-04-13", "2018-03-04 25:00": None,
             "2018-13-04T10:00:00": None, "31/31/2018": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    got = df.select("s", "want", parse_fl_date("s").cast("string").alias("got")).collect()
    assert {r.s: r.got for r in got} == cases


def test_position_log_with_two_sinks(spark):
    base = _fresh(spark)
    one = ["A", "CS", "C1", "99", "100", "1", "2", "3", "false", "4", "5", "6", None, "7", "8", "false", "0"]
    bad = [None, *one[1:]]
    states = spark.createDataFrame([(0, one), (1, one), (2, ["B", *one[1:]]), (3, bad)], "seq long, state array<string>")
    src = pos.replay_folder(spark, pos.states_to_messages(states), base, parts=2)
    sinks = {}
    for rejected in (None, f"{base}/rejected"):
        out = f"{base}/out-{rejected is None}"
        log = pos.start_position_log(pos.read_message_stream(spark, src), out, f"{out}-state", trigger={"availableNow": True},
                                     dedup=True, rejected_path=rejected)
        log.awaitTermination()
        sinks[rejected is None] = spark.read.parquet(out)
    assert sinks[True].columns == sinks[False].columns
    for rows in sinks.values():
        assert sorted(r.icao24 for r in rows.collect()) == ["A", "B"]
    assert [r.reject_reason for r in spark.read.parquet(f"{base}/rejected").select(F.col("reject_reason")).collect()] == ["missing icao24"]
