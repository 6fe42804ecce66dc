"""M4: rounds by patience, the best round, and a run that died."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from airmetrics.plans import boosting


@pytest.fixture(scope="module")
def data(spark):
    x = F.col("id") % 17
    noise = (F.xxhash64("id") % 100) / 100.0
    df = spark.range(600).select((x * 1.0).alias("x"), ((F.col("id") % 5) * 1.0).alias("z"), (F.when(x > 8, 6.0).otherwise(-6.0) + noise).alias("residual"),
                                 (F.col("id") % 4 == 0).alias("is_validation"))
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df).repartition(3).cache()


def predictions(model, data):
    return [r["prediction"] for r in model.transform(data.orderBy("x", "z", "residual")).collect()]


def test_rounds_follow_the_residuals(spark, data, tmp_path):
    model, history = boosting.boost(data, str(tmp_path / "a"), rounds=7, depth=2, stage=3)
    assert len(history) == 8 and model.getNumTrees == 7 == boosting.best_round(history)
    assert all(b < a for a, b in zip(history, history[1:]))
    # each round takes a tenth of what is left: the error of a clean step shrinks by 0.9
    assert all(abs(b / a - 0.9) < 0.02 for a, b in zip(history, history[1:]))
    left = data.where("is_validation")
    got = model.transform(left).agg(F.avg(F.abs(F.col("residual") - F.col("prediction")))).first()[0]
    assert abs(got - history[-1]) < 1e-9


def test_patience_ends_training_and_the_best_round_counts(spark, data, tmp_path):
    # validation rows that say the opposite: every round makes them worse
    against = data.withColumn("residual", F.when(F.col("is_validation"), -F.col("residual")).otherwise(F.col("residual")))
    model, history = boosting.boost(against, str(tmp_path / "a"), rounds=100, depth=2, patience=4, stage=3)
    assert len(history) == 5 and boosting.best_round(history) == 0
    assert set(predictions(model, data)) == {0.0}
    assert boosting.best_round([3.0, 2.0, 2.0, 2.5]) == 1 and boosting.best_round([None, None, None]) == 2


def test_a_run_that_died_goes_on_with_the_same_model(spark, data, tmp_path, monkeypatch):
    whole, history = boosting.boost(data, str(tmp_path / "whole"), rounds=6, depth=2, stage=2)
    kept, saved = boosting.ensemble, []

    def dies(spark, trees, step):
        saved.append(len(trees))
        if len(saved) == 7:  # within the third stage
            raise RuntimeError("lost")
        return kept(spark, trees, step)

    monkeypatch.setattr(boosting, "ensemble", dies)
    with pytest.raises(RuntimeError):
        boosting.boost(data, str(tmp_path / "died"), rounds=6, depth=2, stage=2)
    monkeypatch.setattr(boosting, "ensemble", kept)
    assert len(GBTRegressionModel.load(str(tmp_path / "died" / "stage-00002" / "trees")).trees) == 2
    # the given rows are not read again: the stages hold all that is needed
    again, later = boosting.boost(data.limit(0), str(tmp_path / "died"), rounds=6, depth=2, stage=2)
    assert later == pytest.approx(history, abs=1e-9)
    assert predictions(again, data) == pytest.approx(predictions(whole, data), abs=1e-9)


def test_without_validation_rows_all_rounds_count_and_without_fit_rows_it_fails(spark, data, tmp_path):
    model, history = boosting.boost(data.where("not is_validation"), str(tmp_path / "a"), rounds=3, depth=2)
    assert history == [None] * 4 and model.getNumTrees == 3
    with pytest.raises(ValueError):
        boosting.boost(data.where("is_validation"), str(tmp_path / "b"))
