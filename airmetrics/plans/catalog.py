"""Query catalog: name -> (Spark job over the driver tables, DuckDB oracle text).

Every job reads the driver tables at ``sf_dir`` (or frames Spark derives from
them) and runs over all rows. ``oracle`` is None for jobs that SQL cannot express
(the driver then checks row counts only).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from airmetrics.operators import charts
from airmetrics.operators import modelling as mdl
from airmetrics.operators.histogram import histogram
from airmetrics.plans.oracle_sql import with_base
from airmetrics.session import configure
from airmetrics.sources import fixtures as fx


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    """Every query applies the runtime settings to the session it is given: without them the cleaning
    projection stays one interpreted method above the JIT's size limit."""
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        REGISTRY[name] = Query(run, oracle)
        return fn
    return deco


# --------------------------------------------------------------------------- inputs

def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdl.build_flights(fx.flights_raw(spark, sf_dir))


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.airports(spark, sf_dir)


# --------------------------------------------------------------------------- charts A1-A17

@register("delay_by_state", with_base("""
SELECT a.state_name AS state_name, avg(f.arr_delay) AS mean_delay
FROM flights f JOIN airports1 a ON f.origin_airport_id = a.airport_id
GROUP BY a.state_name HAVING avg(f.arr_delay) IS NOT NULL
ORDER BY mean_delay DESC, state_name LIMIT 10"""))
def q_delay_by_state(spark, sf_dir):
    return charts.delay_by_state(flights(spark, sf_dir), airports(spark, sf_dir))


@register("delay_by_state_fanout", with_base("""
SELECT a.state_name AS state_name, avg(f.arr_delay) AS mean_delay
FROM flights f JOIN airports a ON f.origin_airport_id = a.airport_id
GROUP BY a.state_name HAVING avg(f.arr_delay) IS NOT NULL
ORDER BY mean_delay DESC, state_name LIMIT 10"""))
def q_delay_by_state_fanout(spark, sf_dir):
    return charts.delay_by_state(flights(spark, sf_dir), airports(spark, sf_dir), fanout=True)


@register("delay_by_airport", with_base("""
SELECT CAST(origin_airport_id AS VARCHAR) AS origin_airport_id, avg(arr_delay) AS arr_delay
FROM flights WHERE origin_airport_id IS NOT NULL
GROUP BY 1 HAVING avg(arr_delay) IS NOT NULL
ORDER BY arr_delay DESC, origin_airport_id LIMIT 10"""))
def q_delay_by_airport(spark, sf_dir):
    return charts.delay_by_airport(flights(spark, sf_dir))


@register("flight_counts", with_base("""
SELECT op_carrier, flights, flights / sum(flights) OVER () AS share FROM (
  SELECT op_carrier, count(*) AS flights FROM flights WHERE op_carrier IS NOT NULL
  GROUP BY op_carrier ORDER BY flights DESC, op_carrier LIMIT 10) t"""))
def q_flight_counts(spark, sf_dir):
    return charts.flight_counts(flights(spark, sf_dir))


@register("arrival_delay_histogram", with_base("""
SELECT CAST(floor(arr_delay / w) AS DOUBLE) * w AS bin_start,
       CAST(floor(arr_delay / w) AS DOUBLE) * w + w AS bin_end, count(*) AS n
FROM flights, wd WHERE arr_delay IS NOT NULL GROUP BY 1, 2""", extra_ctes="""
bounds AS (SELECT min(arr_delay) AS lo, max(arr_delay) AS hi FROM flights),
cand AS (SELECT lo, hi, (hi - lo) / 49.0 AS t, floor(log10((hi - lo) / 49.0)) AS k FROM bounds WHERE hi > lo),
wd AS (
  SELECT coalesce((SELECT min(m * pow(10.0, k + e)) FROM cand,
                   (VALUES (1.0), (2.0), (5.0)) ms(m), (VALUES (-1), (0), (1)) es(e)
                   WHERE m * pow(10.0, k + e) >= t), 1.0) AS w
)"""))
def q_arrival_delay_histogram(spark, sf_dir):
    return histogram(flights(spark, sf_dir), "arr_delay", bins=50)


@register("cancelled_flights", with_base("""
SELECT op_carrier, count(*) AS cancelled_count FROM flights
WHERE cancelled AND op_carrier IS NOT NULL GROUP BY op_carrier
ORDER BY cancelled_count DESC, op_carrier LIMIT 10"""))
def q_cancelled_flights(spark, sf_dir):
    return charts.cancelled_flights(flights(spark, sf_dir))


@register("airtime_by_route", with_base("""
SELECT CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR) AS route,
       avg(air_time) AS avg_air_time
FROM flights WHERE origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL AND air_time IS NOT NULL
GROUP BY 1 ORDER BY avg_air_time DESC, route LIMIT 10"""))
def q_airtime_by_route(spark, sf_dir):
    return charts.airtime_by_route(flights(spark, sf_dir))


@register("flights_by_date", with_base("""
SELECT fl_date, count(*) AS n_flights FROM flights WHERE fl_date IS NOT NULL GROUP BY fl_date"""))
def q_flights_by_date(spark, sf_dir):
    return charts.flights_by_date(flights(spark, sf_dir))


@register("delay_by_hour", with_base("""
SELECT CAST(floor(crs_dep_time / 3600) AS INTEGER) AS hour, avg(arr_delay) AS avg_delay
FROM flights WHERE crs_dep_time IS NOT NULL GROUP BY 1 HAVING avg(arr_delay) IS NOT NULL"""))
def q_delay_by_hour(spark, sf_dir):
    return charts.delay_by_hour(flights(spark, sf_dir))


@register("delay_by_airline", with_base("""
SELECT op_carrier, avg(arr_delay) AS avg_arr_delay FROM flights WHERE op_carrier IS NOT NULL
GROUP BY op_carrier HAVING avg(arr_delay) IS NOT NULL
ORDER BY avg_arr_delay DESC, op_carrier LIMIT 10"""))
def q_delay_by_airline(spark, sf_dir):
    return charts.delay_by_airline(flights(spark, sf_dir))


@register("distance_airtime_pairs", with_base("""
SELECT flight_id, distance, air_time FROM flights WHERE distance IS NOT NULL AND air_time IS NOT NULL"""))
def q_distance_airtime_pairs(spark, sf_dir):
    return charts.distance_airtime_pairs(flights(spark, sf_dir))


@register("distance_airtime_points", with_base("""
SELECT distance, air_time, count(*) AS n FROM flights WHERE distance IS NOT NULL AND air_time IS NOT NULL
GROUP BY distance, air_time"""))
def q_distance_airtime_points(spark, sf_dir):
    return charts.distance_airtime_points(flights(spark, sf_dir))


@register("cancellation_rate", with_base("""
SELECT op_carrier, 100.0 * count(*) FILTER (WHERE cancelled) / count(*) AS cancel_rate_pct
FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier
HAVING count(*) FILTER (WHERE cancelled) > 0
ORDER BY cancel_rate_pct DESC, op_carrier LIMIT 10"""))
def q_cancellation_rate(spark, sf_dir):
    return charts.cancellation_rate(flights(spark, sf_dir))


@register("most_common_routes", with_base("""
SELECT CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR) AS route,
       count(*) AS n_flights
FROM flights WHERE origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL
GROUP BY 1 ORDER BY n_flights DESC, route LIMIT 10"""))
def q_most_common_routes(spark, sf_dir):
    return charts.most_common_routes(flights(spark, sf_dir))


@register("delay_by_weekday", with_base("""
SELECT CAST(isodow(fl_date) AS INTEGER) AS weekday_no, dayname(fl_date) AS weekday, avg(arr_delay) AS avg_delay
FROM flights WHERE fl_date IS NOT NULL AND arr_delay IS NOT NULL GROUP BY 1, 2"""))
def q_delay_by_weekday(spark, sf_dir):
    return charts.delay_by_weekday(flights(spark, sf_dir))


@register("most_diverted_airports", with_base("""
SELECT CAST(dest_airport_id AS VARCHAR) AS dest_airport_id, count(*) AS diverted_count
FROM flights WHERE diverted AND dest_airport_id IS NOT NULL GROUP BY 1
ORDER BY diverted_count DESC, dest_airport_id LIMIT 10"""))
def q_most_diverted_airports(spark, sf_dir):
    return charts.most_diverted_airports(flights(spark, sf_dir))


@register("monthly_delay_trend", with_base("""
SELECT CAST(month(fl_date) AS INTEGER) AS month_no, monthname(fl_date) AS month, avg(arr_delay) AS avg_delay
FROM flights WHERE fl_date IS NOT NULL AND arr_delay IS NOT NULL GROUP BY 1, 2"""))
def q_monthly_delay_trend(spark, sf_dir):
    return charts.monthly_delay_trend(flights(spark, sf_dir))


@register("top_planes", with_base("""
SELECT op_carrier_fl_num, count(*) AS n_flights FROM flights GROUP BY op_carrier_fl_num
ORDER BY n_flights DESC, op_carrier_fl_num ASC NULLS LAST LIMIT 5"""))
def q_top_planes(spark, sf_dir):
    return charts.top_planes(flights(spark, sf_dir))


@register("top_airlines", with_base("""
SELECT op_carrier, count(*) AS n_flights FROM flights GROUP BY op_carrier
ORDER BY n_flights DESC, op_carrier ASC NULLS LAST LIMIT 5"""))
def q_top_airlines(spark, sf_dir):
    return charts.top_airlines(flights(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    """Import every module that registers queries, then return the registry."""
    import importlib

    for mod in _QUERY_MODULES:
        importlib.import_module(mod)
    return dict(REGISTRY)


_QUERY_MODULES: list[str] = ["airmetrics.plans.queries_tables", "airmetrics.plans.queries_stream", "airmetrics.plans.queries_sql", "airmetrics.plans.queries_model", "airmetrics.plans.queries_io"]
