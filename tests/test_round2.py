"""Faults found after the first round."""

import pytest

from airmetrics import session
from airmetrics.operators import filters, sqlgate
from airmetrics.plans import delay_model


@pytest.mark.parametrize("text", [
    "select `reflect`('java.lang.Math', 'abs', -5)",
    "select reflect/**/('java.lang.Math', 'abs', -5)",
    "with a as (select 1 x) insert overwrite directory '/tmp/never' using parquet select * from a",
])
def test_guard_looks_at_the_parsed_plan(spark, text):
    with pytest.raises(sqlgate.SqlRefused):
        sqlgate.run_select(spark, {}, text)


def test_guard_lets_queries_pass(spark):
    got = sqlgate.run_select(spark, {"t": spark.range(5)}, "with a as (select id from t) select max(id) m from a where id < 4")
    assert got.first()["m"] == 3


def test_checkpoint_folder_is_kept(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()


def test_window_of_an_empty_table():
    assert filters.resolve_window(None, None, None, None) == filters.Window(None, None, None)


def test_encoders_see_train_rows_only(spark):
    cols = "flight_id long, op_carrier_airline_id int, tail_num string, origin_airport_id int, dest_airport_id int, " \
           "distance double, flights double, arr_delay double"
    train = spark.createDataFrame([(i, 1, f"N{i % 4}", i % 3, i % 2, 100.0 + i, 1.0, float(i % 7)) for i in range(60)], cols)
    other = spark.createDataFrame([(100, 1, "ONLY", 0, 1, 100.0, 1.0, 5000.0)], cols)
    model = delay_model.fit_delay_model(train, validation=other, max_iter=2, max_depth=2)
    row = model.transform(other.selectExpr("*", "true AS is_validation")).first()
    assert abs(row["tail_num_te"] - train.agg({"arr_delay": "avg"}).first()[0]) < 1e-6
