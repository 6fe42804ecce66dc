"""Loads with a ledger."""

import pytest

from airmetrics.sources import ledger

COLS = "fl_date date, op_carrier string, origin_airport_id int, dest_airport_id int, crs_dep_time int"


def rows(spark, n, at=0, bad=0):
    return spark.sql(f"SELECT date_add(DATE '2020-01-01', cast(id AS int)) AS fl_date, if(id < {at + bad}, null, 'C') AS op_carrier, "
                     f"1 AS origin_airport_id, 2 AS dest_airport_id, 60 AS crs_dep_time FROM range({at}, {at + n})")


def test_loads_compare_with_their_own_source_only(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = [ledger.load(rows(spark, 10, at=100 * k, bad=2), f"f{k}.csv", path) for k in range(3)]
    assert [r["n_compared"] for r in lines] == [0, 0, 0] and [r["n_valid"] for r in lines] == [8, 8, 8]
    again = ledger.load(rows(spark, 15, at=100, bad=2).union(rows(spark, 1, at=104)), "f1.csv", path)
    # ten rows known; five further ones and the second copy of one row are new
    assert (again["n_read"], again["n_compared"], again["n_new"], again["n_rejected"]) == (16, 10, 6, 0)
    assert ledger.load(rows(spark, 10, bad=2), "f0.csv", path)["n_new"] == 0
    got = ledger.loaded(spark, path, rows(spark, 0).schema)
    ids = sorted(r["flight_id"] for r in got.collect() if r["flight_id"] is not None)
    assert ids == list(range(1, 31)) and got.count() == 36
    plan = ledger.loaded(spark, path, rows(spark, 0).schema, "f1.csv")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "f1.csv" in plan.split("PartitionFilters: [")[1]


def test_a_load_that_died_is_taken_again(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.load(rows(spark, 4), "a.csv", path)

    def stop():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        ledger.load(rows(spark, 5, at=50), "b.csv", path, before_line=stop)
    assert ledger.loaded(spark, path, rows(spark, 0).schema).count() == 4
    assert ledger.load(rows(spark, 6, at=70), "c.csv", path)["load_id"] == 2
    assert ledger.load(rows(spark, 5, at=50), "b.csv", path)["n_new"] == 5
    got = ledger.loaded(spark, path, rows(spark, 0).schema)
    assert got.count() == got.select("fl_date").distinct().count() == 15


def test_empty_deliveries(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ledger.ledger(spark, path).count() == 0
    assert ledger.load(rows(spark, 0), "a.csv", path)["n_new"] == 0
    assert ledger.load(rows(spark, 2), "a.csv", path)["n_valid"] == 2
    assert ledger.loaded(spark, path, rows(spark, 0).schema).count() == 2
