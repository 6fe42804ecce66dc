"""M4: rows as cells of bins, trees as Spark ML grows them, and few jobs a round."""

import uuid

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from airmetrics.plans import boosting


@pytest.fixture(scope="module")
def data(spark):
    h = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000))
    df = spark.range(3000).select(((h(1) % 9) * 1.0).alias("a"), (h(2) / 7.0).alias("b"), F.lit(1.0).alias("c"), (h(3) * 0.5).alias("d"),
                                  (h(0) % 4 == 0).alias("is_validation"), h(4).alias("e"))
    df = df.withColumn("residual", F.when(F.col("a") > 4, F.col("b")).otherwise(-F.col("d")) + F.floor(F.col("e") / 50) - 3)
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).repartition(5).cache()


@pytest.fixture(params=["driver", "executors"])
def worked_on(request, monkeypatch):
    if request.param == "executors":
        monkeypatch.setattr(boosting, "HERE_BYTES", 0)
        monkeypatch.setattr(boosting, "BLOCK", 100)
    return request.param


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_tree_is_the_one_that_spark_ml_fits(spark, data, tmp_path, worked_on):
    want = DecisionTreeRegressor(featuresCol="features", labelCol="residual", maxDepth=3).fit(data.where("not is_validation"))
    model, history = boosting.boost(data, str(tmp_path / "a"), rounds=1, depth=3, step=1.0)
    both = model.transform(want.transform(data).withColumnRenamed("prediction", "want"))
    assert both.agg(F.max(F.abs(F.col("want") - F.col("prediction")))).first()[0] < 1e-9
    assert history[1] == pytest.approx(want.transform(data.where("is_validation")).agg(F.avg(F.abs(F.col("residual") - F.col("prediction")))).first()[0])
    root, wanted = model.trees[0]._java_obj.rootNode(), want._java_obj.rootNode()
    assert [root.impurity(), root.gain(), root.split().threshold()] == pytest.approx([wanted.impurity(), wanted.gain(), wanted.split().threshold()])
    assert list(model.trees[0].featureImportances) == pytest.approx(list(want.featureImportances))


def test_rounds_take_few_jobs(spark, data, tmp_path, worked_on):
    run = lambda n: jobs(spark, lambda: boosting.boost(data, str(tmp_path / f"r{n}"), rounds=n, depth=4, stage=50))
    (_, few), (_, more) = run(2), run(12)
    # a job a level where the executors do the sums
    assert more - few <= (10 * 4 if worked_on == "executors" else 0)


def test_both_ways_give_one_model(spark, data, tmp_path, monkeypatch):
    _, here = boosting.boost(data, str(tmp_path / "here"), rounds=5, depth=4, stage=2)
    monkeypatch.setattr(boosting, "HERE_BYTES", 0)
    _, there = boosting.boost(data, str(tmp_path / "there"), rounds=5, depth=4, stage=2)
    assert there == pytest.approx(here, abs=1e-9)


def test_rows_are_kept_as_cells_and_none_is_lost(spark, data, tmp_path, worked_on):
    many = data.union(data).union(data)
    boosting.boost(many, str(tmp_path / "a"), rounds=1, depth=2)
    blocks = spark.sparkContext.pickleFile(str(tmp_path / "a" / "stage-00001" / "rows")).collect()
    count = lambda flag: (sum(len(b[3]) for b in blocks if b[0] == flag), sum(b[3].sum() for b in blocks if b[0] == flag))
    fit, validation = (data.where(c) for c in ("not is_validation", "is_validation"))
    assert count(False)[1] == 3 * fit.count() and count(True)[1] == 3 * validation.count()
    assert count(False)[0] <= fit.count() and count(True)[0] <= validation.count()


def test_split_points_by_hand():
    assert list(boosting.split_points(np.array([1.0, 1.0, 3.0, 9.0]))) == [2.0, 6.0]
    assert list(boosting.split_points(np.array([5.0] * 9))) == []
    even = boosting.split_points(np.arange(640.0))
    assert len(even) == 31 and even[0] == 19.5 and set(np.diff(even)) == {20.0}


def test_constant_features_and_rows_without_residual(spark, data, tmp_path):
    flat = VectorAssembler(inputCols=["c"], outputCol="f2").transform(data).drop("features").withColumnRenamed("f2", "features")
    model, history = boosting.boost(flat, str(tmp_path / "a"), rounds=2, depth=3, step=1.0)
    mean = data.where("not is_validation").agg(F.avg("residual")).first()[0]
    assert model.trees[0].numNodes == 1 and model.trees[0].predict(flat.first()["features"]) == pytest.approx(mean)
    with pytest.raises(ValueError):
        boosting.boost(data.withColumn("residual", F.when(F.col("a") > 2, F.col("residual"))), str(tmp_path / "b"), rounds=1)
