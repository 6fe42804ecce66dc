"""Catalog entries for the delay model (M1-M7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airmetrics.plans import delay_model as dm
from airmetrics.plans.catalog import flights, register
from airmetrics.plans.oracle_sql import with_base
from airmetrics.session import scratch_path, stored

MODEL_CTES = """
tf AS (
  SELECT flight_id, op_carrier_airline_id, tail_num, origin_airport_id, dest_airport_id, distance, flights, arr_delay
  FROM flights, (SELECT max(fl_date) AS hi FROM flights) b
  WHERE fl_date >= CAST(b.hi - INTERVAL 365 DAY AS DATE) AND arr_delay IS NOT NULL
    AND op_carrier_airline_id IS NOT NULL AND tail_num IS NOT NULL AND origin_airport_id IS NOT NULL
    AND dest_airport_id IS NOT NULL AND distance IS NOT NULL AND flights IS NOT NULL),
sp AS (SELECT *, md5(CAST(flight_id AS VARCHAR) || ':42') < '33333333333333333333333333333333' AS is_test FROM tf),
tr AS (SELECT * FROM sp WHERE NOT is_test),
te AS (SELECT * FROM sp WHERE is_test),
rm AS (SELECT origin_airport_id, dest_airport_id, avg(arr_delay) AS m FROM tr GROUP BY 1, 2),
sc AS (
  SELECT te.flight_id, te.arr_delay AS real, coalesce(rm.m, (SELECT avg(arr_delay) FROM tr)) AS estimate
  FROM te LEFT JOIN rm ON te.origin_airport_id = rm.origin_airport_id AND te.dest_airport_id = rm.dest_airport_id)"""


def _frames(spark, sf_dir):
    tf = stored(dm.training_frame(flights(spark, sf_dir)), "training-frame")  # fit, encoding and scores all read it
    return dm.split(tf)


@register("training_frame", with_base("SELECT * FROM tf", MODEL_CTES))
def q_training_frame(spark, sf_dir):
    return dm.training_frame(flights(spark, sf_dir))


@register("train_test_split", with_base("SELECT flight_id, is_test FROM sp", MODEL_CTES))
def q_train_test_split(spark, sf_dir):
    return dm.training_frame(flights(spark, sf_dir)).select("flight_id", dm.split_flag().alias("is_test"))


def _encoding_sql() -> str:
    """Out-of-fold means by window sums: those of the value less those of the value within the row's fold."""
    def column(c):
        seen = f"sum(arr_delay) FILTER (NOT is_test) OVER (PARTITION BY {c}), count(*) FILTER (NOT is_test) OVER (PARTITION BY {c})"
        own = (f"sum(arr_delay) FILTER (NOT is_test) OVER (PARTITION BY {c}, fold), "
               f"count(*) FILTER (NOT is_test) OVER (PARTITION BY {c}, fold)")
        (s, n), (os, on) = [x.split(", count") for x in (seen, own)]
        n, on = "count" + n, "count" + on
        rest = f"coalesce({s}, 0) - CASE WHEN is_test THEN 0 ELSE coalesce({os}, 0) END"
        left = f"{n} - CASE WHEN is_test THEN 0 ELSE {on} END"
        return f"round(({rest} + 10.0 * mean) / ({left} + 10.0), 6) AS {c}_te"
    return ("SELECT flight_id, is_test, " + ", ".join(column(c) for c in dm.CATEGORICAL) + " FROM withmean")


@register("target_encoding", with_base(_encoding_sql(), MODEL_CTES + """,
folded AS (SELECT *, (strpos('0123456789abcdef', substr(md5(CAST(flight_id AS VARCHAR) || ':fold42'), 1, 1)) - 1) % 8 AS fold FROM sp),
withmean AS (
  SELECT *, CASE WHEN is_test THEN sum(arr_delay) FILTER (NOT is_test) OVER () / count(*) FILTER (NOT is_test) OVER ()
    ELSE (sum(arr_delay) FILTER (NOT is_test) OVER () - sum(arr_delay) FILTER (NOT is_test) OVER (PARTITION BY fold))
       / (count(*) FILTER (NOT is_test) OVER () - count(*) FILTER (NOT is_test) OVER (PARTITION BY fold)) END AS mean
  FROM folded)"""))
def q_target_encoding(spark, sf_dir):
    train, test = _frames(spark, sf_dir)
    encoding = dm.fit_encoding(train)
    both = encoding.encode(train, out_of_fold=True).withColumn("is_test", F.lit(False)).unionByName(
        encoding.encode(test).withColumn("is_test", F.lit(True)))
    return both.select("flight_id", "is_test", *[F.round(f"{c}_te", 6).alias(f"{c}_te") for c in dm.CATEGORICAL])


@register("regression_metrics", with_base("""
SELECT count(*) AS n, round(avg(abs(real - estimate)), 9) AS mae,
       round(sqrt(avg((real - estimate) * (real - estimate))), 9) AS rmse,
       round(1.0 - sum((real - estimate) * (real - estimate)) / (count(*) * var_pop(real)), 9) AS r2
FROM sc""", MODEL_CTES))
def q_regression_metrics(spark, sf_dir):
    train, test = _frames(spark, sf_dir)
    return dm.regression_metrics(dm.route_mean_scores(train, test))


@register("residual_histogram", with_base("""
SELECT CAST(floor(r / w) AS DOUBLE) * w AS bin_start, CAST(floor(r / w) AS DOUBLE) * w + w AS bin_end, count(*) AS n
FROM (SELECT real - estimate AS r FROM sc) x, wd GROUP BY 1, 2""", MODEL_CTES + """,
bounds AS (SELECT min(real - estimate) AS lo, max(real - estimate) AS hi FROM sc),
cand AS (SELECT lo, hi, (hi - lo) / 29.0 AS t, floor(log10((hi - lo) / 29.0)) AS k FROM bounds WHERE hi > lo),
wd AS (
  SELECT coalesce((SELECT min(m * pow(10.0, k + e)) FROM cand,
                   (VALUES (1.0), (2.0), (5.0)) ms(m), (VALUES (-1), (0), (1)) es(e)
                   WHERE m * pow(10.0, k + e) >= t), 1.0) AS w)"""))
def q_residual_histogram(spark, sf_dir):
    train, test = _frames(spark, sf_dir)
    return dm.residual_histogram(dm.route_mean_scores(train, test), bins=30)


@register("delay_model_metrics", None)
def q_delay_model_metrics(spark, sf_dir):
    train, test = _frames(spark, sf_dir)
    fit_rows, stop_rows = dm.split(train, seed=7)
    model = dm.fit_delay_model(fit_rows, validation=stop_rows)
    return (dm.regression_metrics(dm.score(model, test))
            .withColumn("rounds", F.lit(len(model.history) - 1)).withColumn("best_round", F.lit(model.best_round)))


@register("delay_model_scores", None)
def q_delay_model_scores(spark, sf_dir):
    train, test = _frames(spark, sf_dir)
    fit_rows, stop_rows = dm.split(train, seed=7)
    model = dm.fit_delay_model(fit_rows, validation=stop_rows)
    path = scratch_path(spark, f"delay-model-{uuid.uuid4().hex}")
    dm.save(model, path)
    return dm.score(dm.load(spark, path), test)
