"""M3: out-of-fold label means, and the saved model."""

import pytest
from pyspark.sql import functions as F

from airmetrics.plans import delay_model

COLS = ("flight_id long, op_carrier_airline_id int, tail_num string, origin_airport_id int, dest_airport_id int, "
        "distance double, flights double, arr_delay double")


@pytest.fixture(scope="module")
def rows():
    return [(i, i % 3, f"N{i % 11}", i % 5, i % 2, 100.0 + i, 1.0, float((i * 7) % 23)) for i in range(200)] + [
        (900, 1, "ONCE", 0, 1, 50.0, 1.0, 4000.0)]


@pytest.fixture(scope="module")
def train(spark, rows):
    return spark.createDataFrame(rows, COLS).repartition(3).cache()


def test_out_of_fold_means_equal_brute_force(spark, train, rows):
    folds = {r["flight_id"]: r["f"] for r in train.select("flight_id", delay_model.fold_of().alias("f")).collect()}
    assert set(folds.values()) == set(range(8))
    got = {r["flight_id"]: r for r in delay_model.fit_encoding(train).encode(train, out_of_fold=True).collect()}
    assert len(got) == len(rows)
    for row in rows:
        others = [r for r in rows if folds[r[0]] != folds[row[0]]]
        mean = sum(r[-1] for r in others) / len(others)
        for at, c in enumerate(delay_model.CATEGORICAL, 1):
            same = [r[-1] for r in others if r[at] == row[at]]
            assert abs(got[row[0]][f"{c}_te"] - (sum(same) + 10 * mean) / (len(same) + 10)) < 1e-9


def test_no_train_row_sees_its_own_label(spark, train, rows):
    changed = spark.createDataFrame([(*r[:-1], 1e6) if r[0] in (5, 900) else r for r in rows], COLS)
    pick = lambda df: {r["flight_id"]: [r[f"{c}_te"] for c in delay_model.CATEGORICAL]
                       for r in delay_model.fit_encoding(df).encode(df, out_of_fold=True).where("flight_id in (5, 900)").collect()}
    fold = {r["flight_id"]: r["f"] for r in train.select("flight_id", delay_model.fold_of().alias("f")).where("flight_id in (5, 900)").collect()}
    if fold[5] == fold[900]:
        assert pick(train) == pick(changed)
    one = spark.createDataFrame([(*r[:-1], 1e6) if r[0] == 900 else r for r in rows], COLS)
    assert pick(train)[900] == pick(one)[900]


def test_unseen_values_get_the_mean_and_the_model_survives_saving(spark, train, rows, tmp_path):
    model = delay_model.fit_delay_model(train, max_iter=2, max_depth=2)
    new = spark.createDataFrame([(1, 99, "NEW", 99, 99, 1.0, 1.0, 0.0)], COLS)
    mean = sum(r[-1] for r in rows) / len(rows)
    assert all(abs(model.transform(new).first()[f"{c}_te"] - mean) < 1e-9 for c in delay_model.CATEGORICAL)
    delay_model.save(model, str(tmp_path / "model"))
    again = delay_model.load(spark, str(tmp_path / "model"))
    pick = lambda m: sorted(map(tuple, delay_model.score(m, train).collect()))
    assert pick(model) == pick(again)


def test_encoding_of_an_empty_table(spark, train):
    encoding = delay_model.fit_encoding(train.limit(0))
    assert [r["tail_num_te"] for r in encoding.encode(train.limit(2)).collect()] == [0.0, 0.0]
