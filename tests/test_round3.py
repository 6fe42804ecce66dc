"""Findings of the third round: work that grew faster than its input."""

from airmetrics.plans import catalog, queries_io, queries_model
from airmetrics.sources import ledger
from tests.conftest import SF_SMALL


def test_queries_bring_the_settings_they_rely_on(spark):
    other = spark.newSession()  # a session that nobody configured
    other.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    catalog.all_queries()["build_flights"].run(other, SF_SMALL)
    assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def _no(what):
    def fail(*args, **kwargs):
        raise AssertionError(what)
    return fail


def test_a_new_source_is_not_read_again_to_count_it(spark, tmp_path, monkeypatch):
    rows = spark.sql("SELECT DATE '2020-01-01' AS fl_date, 'C' AS op_carrier, 1 AS origin_airport_id, 2 AS dest_airport_id, "
                     "60 AS crs_dep_time FROM range(7)")
    monkeypatch.setattr(type(rows), "count", _no("counted"))
    monkeypatch.setattr(type(rows), "checkpoint", _no("rows checkpointed"))
    line = ledger.load(rows, "a.csv", str(tmp_path / "t"))
    assert (line["n_read"], line["n_new"], line["n_valid"]) == (7, 7, 7)


def test_deliveries_come_from_one_stored_source(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ledger, "load", lambda src, *args: seen.append(set(src.inputFiles())))
    queries_io._five_loads(spark, SF_SMALL)
    assert len(seen) == 5 and all("/deliveries-" in f for files in seen for f in files)


def test_two_loads_keep_no_row_checkpoint(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", _no("rows checkpointed"))
    assert catalog.all_queries()["unique_flight_ids"].run(spark, SF_SMALL).first()["first_id"] == 1


def test_csv_round_trip_writes_compressed_files(spark):
    files = catalog.all_queries()["csv_round_trip"].run(spark, SF_SMALL).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_model_frames_share_one_stored_training_frame(spark):
    train, test = queries_model._frames(spark, SF_SMALL)
    assert train.inputFiles() and set(train.inputFiles()) == set(test.inputFiles())
    assert all("/training-frame-" in f for f in train.inputFiles())
