"""Findings of the fourth round: boosting rounds that cost jobs and passes over all rows."""

from airmetrics.plans import catalog
from tests.conftest import SF_SMALL


def test_the_model_takes_few_jobs_for_its_rounds(spark):
    spark.sparkContext.setJobGroup("model-metrics", "model-metrics")
    try:
        row = catalog.all_queries()["delay_model_metrics"].run(spark, SF_SMALL).first()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("model-metrics"))
    # patience is 50; a job a tree level and round alone would be 6 a round
    assert row["rounds"] >= 50 and row["rounds"] - row["best_round"] >= 50 and jobs < 4 * row["rounds"]
