"""Sources and sinks: upsert, incremental load, CSV, JDBC options, materialized charts."""

import uuid

from pyspark.sql import functions as F

from airmetrics.session import scratch_path
from airmetrics.sources import files
from airmetrics.sources import tables as tbl


def test_upsert_replaces_and_inserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "k int, v string")
    out = sorted(tuple(r) for r in tbl.upsert(t, u, ["k"]).collect())
    assert out == [(1, "a"), (2, "B"), (3, "d")]
    twice = sorted(tuple(r) for r in tbl.upsert(tbl.upsert(t, u, ["k"]), u, ["k"]).collect())
    assert twice == out


def test_upsert_writes_new_path(spark):
    base = scratch_path(spark, f"t-{uuid.uuid4().hex}")
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    p1 = tbl.upsert_to_new_path(spark, t, t, ["k"], base)
    p2 = tbl.upsert_to_new_path(spark, spark.read.parquet(p1), t, ["k"], base)
    assert p1 != p2 and spark.read.parquet(p2).count() == 1


def test_incremental_split(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "X", 1, 2, 3), (5, None, "X", 1, 2, 3), (6, "2020-01-02", "Y", 1, 2, 3)],
                               "flight_id long, fl_date string, op_carrier string, origin_airport_id int, "
                               "dest_airport_id int, crs_dep_time int")
    ok, bad = tbl.incremental_append(df, 2)
    assert [r.flight_id for r in ok.collect()] == [6]
    assert [(r.flight_id, r.error) for r in bad.collect()] == [(5, "fl_date missing or unparseable")]


def test_jdbc_options():
    o = tbl.jdbc_read_options("jdbc:postgresql://h/db", "flights", "flight_id", 1, 1000, 10)
    assert o["numPartitions"] == "10" and o["partitionColumn"] == "flight_id" and "password" not in o


def test_csv_single_file(spark):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    files.write_csv(spark.range(100).withColumn("x", F.lit("a,b")), path, single=True)
    back = spark.read.option("header", True).schema("id long, x string").csv(path)
    assert back.count() == 100 and back.first().x == "a,b"
    assert len(back.inputFiles()) == 1


def test_materialize_dashboard(spark, flights_small):
    from airmetrics.plans import catalog
    from airmetrics.plans.dashboard import materialize_dashboard
    from tests.conftest import SF_SMALL
    base = scratch_path(spark, f"dash-{uuid.uuid4().hex}")
    paths = materialize_dashboard(flights_small, catalog.airports(spark, SF_SMALL), base)
    assert len(paths) == 15
    assert spark.read.parquet(paths["delay_by_state"]).count() == 5


def test_read_table_parquet_and_append(spark):
    base = scratch_path(spark, f"t-{uuid.uuid4().hex}")
    df = spark.range(10).selectExpr("id", "cast(id % 3 as string) as p")
    files.append_table(df, base, ["p"])
    files.append_table(df, base, ["p"])
    back = tbl.read_table(spark, base)
    assert back.count() == 20 and back.where("p = '1'").count() == 6


def test_to_records(spark):
    rec = files.to_records(spark.createDataFrame([(1, "a", None)], "i int, s string, d double")).first()[0]
    assert rec == '{"i":1,"s":"a","d":null}'  # a null column keeps its key


def test_read_materialized(spark, flights_small):
    from airmetrics.plans import catalog
    from airmetrics.plans.dashboard import materialize_dashboard, read_materialized
    from tests.conftest import SF_SMALL
    base = scratch_path(spark, f"dash-{uuid.uuid4().hex}")
    assert read_materialized(spark, base) is None
    materialize_dashboard(flights_small, catalog.airports(spark, SF_SMALL), base)
    got = read_materialized(spark, base)
    assert len(got) == 15 and len(got["delay_by_state"]) == 5


def test_stored_bounds_read_the_outermost_months(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT id AS flight_id, if(id = 5, null, date_add(DATE '2020-01-15', cast(id * 10 AS int))) AS fl_date FROM range(20)")
    files.write_flights(rows, path)
    assert [str(d) for d in files.stored_bounds(spark, path)] == ["2020-01-15", "2020-07-23"]
    for month in ("2019-12", "2020-08"):  # folders whose rows were all removed
        rows.select("flight_id", "fl_date").limit(0).write.parquet(f"{path}/fl_month={month}")
    assert [str(d) for d in files.stored_bounds(spark, path)] == ["2020-01-15", "2020-07-23"]
    files.write_flights(rows.where("flight_id < 0"), str(tmp_path / "e"))
    assert files.stored_bounds(spark, str(tmp_path / "e")) == (None, None)
    files.write_flights(rows.where("flight_id = 5"), str(tmp_path / "u"))
    assert files.stored_bounds(spark, str(tmp_path / "u")) == (None, None)
