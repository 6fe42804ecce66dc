"""Catalog entries for cleaning/modelling (C), profiling (P) and filters/paging (F)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airmetrics.operators import filters as flt
from airmetrics.operators import modelling as mdl
from airmetrics.operators import profile as prof
from airmetrics.plans.catalog import airports, flights, register
from airmetrics.plans.oracle_sql import clock_sql, with_base
from airmetrics.schemas import FLIGHT_COLUMNS
from airmetrics.session import cut_lineage, scratch_path
from airmetrics.sources import files
from airmetrics.sources import fixtures as fx

# ----------------------------------------------------------------------------- raw oracle pieces

RAW_CTE = """
raw AS (
  SELECT fz.*,
    CASE WHEN pk % 97 = 5 THEN 'unknown' WHEN ln % 3 = 0 THEN strftime(ship, '%Y-%m-%d')
         WHEN ln % 3 = 1 THEN strftime(ship, '%Y%m%d') ELSE strftime(ship, '%m/%d/%Y') END AS fl_date_raw,
    CASE ok % 101 WHEN 0 THEN 2400.0 WHEN 1 THEN 2475.0 WHEN 2 THEN 1275.0 WHEN 3 THEN NULL
         ELSE CAST((pk % 24) * 100 + sk % 60 AS DOUBLE) END AS crs_raw,
    CASE ok % 101 WHEN 0 THEN 2400.0 WHEN 1 THEN 2475.0 WHEN 2 THEN 1275.0 WHEN 3 THEN NULL
         ELSE CAST((pk % 24) * 100 + (sk % 60 + ln) % 60 AS DOUBLE) END AS clk_raw,
    CASE WHEN snk % 7 = 0 AND ln % 2 = 0 THEN 2 ELSE 1 END AS oseq,
    CASE WHEN cnk % 7 = 0 AND ln % 2 = 0 THEN 2 ELSE 1 END AS dseq
  FROM fz
),
places AS (
  SELECT n_nationkey AS nk, n_name AS name, CAST(30000 + n_nationkey AS VARCHAR) AS market,
         substr(r_name, 1, 2) AS abr, CAST(n_regionkey AS VARCHAR) AS fips, r_name AS stname,
         CAST(n_regionkey AS INTEGER) AS wac
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def _raw(spark, sf_dir):
    return fx.flights_raw(spark, sf_dir)


@register("canonical_columns", with_base("""
SELECT CAST(((ok * 100000 + pk) * 10000 + sk) * 10 + ln AS BIGINT) AS flight_id,
  'N' || CAST(sk AS VARCHAR) AS tail_num,
  fl_date_raw AS fl_date, brand AS op_unique_carrier, CAST(19000 + b AS INTEGER) AS op_carrier_airline_id,
  brand AS op_carrier, CAST(pk AS VARCHAR) AS op_carrier_fl_num,
  CAST(10000 + snk AS INTEGER) AS origin_airport_id, CAST((10000 + snk) * 100 + oseq AS INTEGER) AS origin_airport_seq_id,
  o.market AS origin_city_market_id, o.name AS origin, o.name AS origin_city_name, o.abr AS origin_state_abr,
  o.fips AS origin_state_fips, o.stname AS origin_state_nm, o.wac AS origin_wac,
  CAST(10000 + cnk AS INTEGER) AS dest_airport_id, CAST((10000 + cnk) * 100 + dseq AS INTEGER) AS dest_airport_seq_id,
  d.market AS dest_city_market_id, d.name AS dest, d.name AS dest_city_name, d.abr AS dest_state_abr,
  d.fips AS dest_state_fips, d.stname AS dest_state_nm, d.wac AS dest_wac,
  crs_raw AS crs_dep_time, clk_raw AS dep_time,
  CASE WHEN canc THEN '' ELSE CAST(CAST(floor(qty) - 25 AS DOUBLE) AS VARCHAR) END AS dep_delay,
  clk_raw AS wheels_off, clk_raw AS wheels_on, clk_raw AS crs_arr_time, clk_raw AS arr_time,
  CASE WHEN canc OR dive THEN '' ELSE CAST(CAST(floor(qty) - 20 AS DOUBLE) AS VARCHAR) END AS arr_delay,
  CASE WHEN canc THEN 1.0 ELSE 0.0 END AS cancelled,
  CASE WHEN dive THEN 1.0 WHEN ok % 37 = 2 THEN NULL ELSE 0.0 END AS diverted,
  CASE WHEN canc THEN '' ELSE CAST(CAST(30 + 18 * hop + ln AS DOUBLE) AS VARCHAR) END AS air_time,
  '1.0' AS flights,
  CAST(CAST(100 + 150 * hop AS DOUBLE) AS VARCHAR) AS distance
FROM raw JOIN places o ON o.nk = snk JOIN places d ON d.nk = cnk""", RAW_CTE))
def q_canonical_columns(spark, sf_dir):
    return mdl.canonical_columns(_raw(spark, sf_dir))


@register("parse_iso_dates", with_base("""
SELECT CAST(((ok * 100000 + pk) * 10000 + sk) * 10 + ln AS BIGINT) AS flight_id, CASE WHEN pk % 97 <> 5 AND ln % 3 = 0 THEN CAST(ship AS DATE) END AS fl_date
FROM raw""", RAW_CTE))
def q_parse_iso_dates(spark, sf_dir):
    from airmetrics.functions.clean import parse_iso_date
    return _raw(spark, sf_dir).select(F.col("FLIGHT_ID").alias("flight_id"), parse_iso_date("FL_DATE", fail=False).alias("fl_date"))


@register("parse_flight_dates", with_base("""
SELECT CAST(((ok * 100000 + pk) * 10000 + sk) * 10 + ln AS BIGINT) AS flight_id, fl_date_raw,
       CASE WHEN pk % 97 = 5 THEN NULL ELSE CAST(ship AS DATE) END AS fl_date
FROM raw""", RAW_CTE))
def q_parse_flight_dates(spark, sf_dir):
    from airmetrics.functions.clean import parse_fl_date
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("FLIGHT_ID").alias("flight_id"), F.col("FL_DATE").alias("fl_date_raw"),
                      parse_fl_date("FL_DATE").alias("fl_date"))


@register("parse_hhmm_times", with_base(f"""
SELECT CAST(((ok * 100000 + pk) * 10000 + sk) * 10 + ln AS BIGINT) AS flight_id, crs_raw AS crs_dep_time_raw,
       {clock_sql("sk % 60")} AS crs_dep_time, {clock_sql("(sk % 60 + ln) % 60")} AS dep_time
FROM raw""", RAW_CTE))
def q_parse_hhmm_times(spark, sf_dir):
    from airmetrics.functions.clean import hhmm_to_seconds
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("FLIGHT_ID").alias("flight_id"), F.col("CRS_DEP_TIME").alias("crs_dep_time_raw"),
                      hhmm_to_seconds("CRS_DEP_TIME").alias("crs_dep_time"),
                      hhmm_to_seconds("DEP_TIME").alias("dep_time"))


@register("coerce_flags", with_base("SELECT flight_id, cancelled, diverted FROM flights"))
def q_coerce_flags(spark, sf_dir):
    from airmetrics.functions.clean import to_bool
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("FLIGHT_ID").alias("flight_id"), to_bool("CANCELLED").alias("cancelled"),
                      to_bool("DIVERTED").alias("diverted"))


@register("coerce_numeric", with_base(
    "SELECT flight_id, dep_delay, arr_delay, air_time, distance, flights FROM flights"))
def q_coerce_numeric(spark, sf_dir):
    from airmetrics.functions.clean import to_number
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("FLIGHT_ID").alias("flight_id"),
                      *[to_number(c.upper()).alias(c) for c in ["dep_delay", "arr_delay", "air_time", "distance", "flights"]])


@register("build_airlines", with_base("""
SELECT op_carrier_airline_id AS airline_id, min(op_unique_carrier) AS unique_carrier
FROM flights WHERE op_carrier_airline_id IS NOT NULL GROUP BY 1"""))
def q_build_airlines(spark, sf_dir):
    return mdl.build_airlines(flights(spark, sf_dir))


@register("build_airports", with_base("""
SELECT airport_id, airport_seq_id, min(market) AS city_market_id, min(name) AS code, min(name) AS city_name,
       min(abr) AS state_abr, min(fips) AS state_fips, min(stname) AS state_name, min(wac) AS wac
FROM (
  SELECT CAST(10000 + snk AS INTEGER) AS airport_id, CAST((10000 + snk) * 100 + oseq AS INTEGER) AS airport_seq_id, p.*
  FROM raw JOIN places p ON p.nk = snk
  UNION ALL
  SELECT CAST(10000 + cnk AS INTEGER), CAST((10000 + cnk) * 100 + dseq AS INTEGER), p.*
  FROM raw JOIN places p ON p.nk = cnk) t
GROUP BY airport_id, airport_seq_id""", RAW_CTE))
def q_build_airports(spark, sf_dir):
    return mdl.build_airports(mdl.canonical_columns(_raw(spark, sf_dir)))


_ALL = ", ".join(FLIGHT_COLUMNS)


@register("build_flights", with_base(f"SELECT {_ALL} FROM flights"))
def q_build_flights(spark, sf_dir):
    return flights(spark, sf_dir)


@register("normalize_export", with_base(
    "SELECT " + ", ".join("strftime(fl_date, '%Y-%m-%d') AS fl_date" if c == "fl_date" else c
                          for c in FLIGHT_COLUMNS) + " FROM flights"))
def q_normalize_export(spark, sf_dir):
    return mdl.normalize_for_export(flights(spark, sf_dir))


# ----------------------------------------------------------------------------- profiling

@register("head_flights", with_base(f"SELECT {_ALL} FROM flights ORDER BY flight_id LIMIT 5"))
def q_head_flights(spark, sf_dir):
    return prof.head(flights(spark, sf_dir), 5)


DESCRIBE_COLS = ["op_carrier_airline_id", "origin_airport_id", "dest_airport_id", "crs_dep_time", "dep_time", "dep_delay",
                 "wheels_off", "wheels_on", "crs_arr_time", "arr_time", "arr_delay", "air_time", "distance", "flights"]


def _describe_sql() -> str:
    parts = []
    for c in DESCRIBE_COLS:
        for stat, expr in [("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"),
                           ("std", f"round(stddev_samp({c}), 9)"), ("min", f"min({c})"), ("max", f"max({c})"),
                           ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"),
                           ("75%", f"quantile_cont({c}, 0.75)")]:
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, CAST({expr} AS DOUBLE) AS value FROM flights")
    return with_base("\nUNION ALL\n".join(parts))


@register("describe_flights", _describe_sql())
def q_describe_flights(spark, sf_dir):
    return prof.describe(flights(spark, sf_dir), DESCRIBE_COLS)


_SPARK_TYPES = {"flight_id": "bigint", "fl_date": "date", "op_carrier_airline_id": "int", "origin_airport_id": "int",
                "dest_airport_id": "int", "cancelled": "boolean", "diverted": "boolean"}


def _null_profile_sql() -> str:
    from airmetrics.schemas import FLIGHTS
    names = {"StringType()": "string", "IntegerType()": "int", "LongType()": "bigint", "DoubleType()": "double",
             "BooleanType()": "boolean", "DateType()": "date"}
    parts = [f"SELECT '{f.name}' AS column_name, '{names[repr(f.dataType)]}' AS data_type, count({f.name}) AS non_null "
             f"FROM flights" for f in FLIGHTS.fields]
    return with_base("\nUNION ALL\n".join(parts))


@register("null_profile", _null_profile_sql())
def q_null_profile(spark, sf_dir):
    return prof.null_profile(flights(spark, sf_dir))


@register("count_flights", with_base("SELECT count(*) AS n_rows FROM flights"))
def q_count_flights(spark, sf_dir):
    return prof.row_count(flights(spark, sf_dir))


@register("date_bounds", with_base("SELECT min(fl_date) AS min_date, max(fl_date) AS max_date FROM flights"))
def q_date_bounds(spark, sf_dir):
    return prof.date_bounds(flights(spark, sf_dir))


# ----------------------------------------------------------------------------- filters and paging

@register("flights_between", with_base(
    f"SELECT {_ALL} FROM flights WHERE fl_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
def q_flights_between(spark, sf_dir):
    return flt.between_dates(flights(spark, sf_dir), "1996-01-01", "1996-12-31")


@register("filter_dict", with_base("""
SELECT flight_id, op_carrier, origin_airport_id, dest_airport_id FROM flights
WHERE op_carrier IN ('Brand#1', 'Brand#12') AND origin_airport_id = 10003"""))
def q_filter_dict(spark, sf_dir):
    f = flt.apply_filters(flights(spark, sf_dir), {"op_carrier": ["Brand#1", "Brand#12"], "origin_airport_id": 10003,
                                                   "dest_airport_id": None, "no_such_column": 5, "tail_num": ""})
    return f.select("flight_id", "op_carrier", "origin_airport_id", "dest_airport_id")


@register("filter_airlines", with_base(
    "SELECT flight_id, op_carrier FROM flights WHERE op_carrier IN ('Brand#3', 'Brand#7')"))
def q_filter_airlines(spark, sf_dir):
    return flt.filter_airlines(flights(spark, sf_dir), ["Brand#3", "Brand#7"]).select("flight_id", "op_carrier")


def _projection_sql(where: str, tail: str = "") -> str:
    cols = []
    for c in FLIGHT_COLUMNS:
        if c in ("crs_dep_time", "dep_time", "wheels_off", "wheels_on", "crs_arr_time", "arr_time"):
            cols.append(f"CASE WHEN {c} IS NULL THEN NULL ELSE printf('%02d:%02d:%02d', {c} // 3600, ({c} % 3600) // 60, {c} % 60) END AS {c}")
        else:
            cols.append(c)
    return with_base(f"SELECT {', '.join(cols)} FROM flights {where} {tail}")


@register("filter_plane", _projection_sql("WHERE op_carrier_fl_num = '100'"))
def q_filter_plane(spark, sf_dir):
    return flt.flight_projection(flt.filter_plane(flights(spark, sf_dir), "100"))


@register("filter_route", with_base("""
SELECT flight_id, CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR) AS route, arr_delay
FROM flights WHERE origin_airport_id = 10001 AND dest_airport_id = 10003"""))
def q_filter_route(spark, sf_dir):
    f = flt.with_route(flt.filter_route(flights(spark, sf_dir), "10001 → 10003"))
    return f.select("flight_id", "route", "arr_delay")


@register("filter_airport", with_base("""
SELECT flight_id, origin_airport_id, dest_airport_id FROM flights
WHERE origin_airport_id = 10005 OR dest_airport_id = 10005"""))
def q_filter_airport(spark, sf_dir):
    return flt.filter_airport(flights(spark, sf_dir), "10005").select("flight_id", "origin_airport_id", "dest_airport_id")


WINDOW_CTE = "win AS (SELECT max(fl_date) - INTERVAL 365 DAY AS s, max(fl_date) AS e FROM flights)"


@register("last_365_days", with_base("""
SELECT flight_id, fl_date FROM flights, win WHERE fl_date BETWEEN CAST(win.s AS DATE) AND win.e""", WINDOW_CTE))
def q_last_365_days(spark, sf_dir):
    f = flights(spark, sf_dir)
    w = flt.window_from_bounds(f)
    return flt.between_dates(f, w.start, w.end).select("flight_id", "fl_date")


def _facets_sql(src: str) -> str:
    return f"""
SELECT DISTINCT 'route' AS facet, CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR) AS value
  FROM {src} WHERE origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL
UNION ALL SELECT DISTINCT 'plane', op_carrier_fl_num FROM {src} WHERE op_carrier_fl_num IS NOT NULL
UNION ALL SELECT DISTINCT 'airline', op_carrier FROM {src} WHERE op_carrier IS NOT NULL
UNION ALL SELECT 'airport', CAST(airport_id AS VARCHAR) FROM (
  SELECT origin_airport_id AS airport_id FROM {src} UNION SELECT dest_airport_id FROM {src}) a
  WHERE airport_id IS NOT NULL"""


@register("empty_filter_facets", with_base(_facets_sql("wf"), WINDOW_CTE + """,
wf AS (SELECT f.* FROM flights f, win WHERE fl_date BETWEEN CAST(win.s AS DATE) AND win.e)"""))
def q_empty_filter_facets(spark, sf_dir):
    f = flights(spark, sf_dir)
    w = flt.window_from_bounds(f)
    window_frame = flt.between_dates(f, w.start, w.end)
    filtered = flt.filter_plane(window_frame, "no-such-flight-number")
    no_data, fac = flt.empty_result_facets(filtered, window_frame)
    assert no_data
    return fac


@register("facet_routes", with_base("""
SELECT DISTINCT CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR) AS route
FROM flights WHERE origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL"""))
def q_facet_routes(spark, sf_dir):
    return flt.facet_routes(flights(spark, sf_dir))


@register("facet_planes", with_base(
    "SELECT DISTINCT op_carrier_fl_num FROM flights WHERE op_carrier_fl_num IS NOT NULL"))
def q_facet_planes(spark, sf_dir):
    return flt.facet_planes(flights(spark, sf_dir))


@register("facet_airlines", with_base("SELECT DISTINCT op_carrier FROM flights WHERE op_carrier IS NOT NULL"))
def q_facet_airlines(spark, sf_dir):
    return flt.facet_airlines(flights(spark, sf_dir))


@register("facet_airports", with_base("""
SELECT airport_id FROM (SELECT origin_airport_id AS airport_id FROM flights UNION SELECT dest_airport_id FROM flights) a
WHERE airport_id IS NOT NULL ORDER BY airport_id"""))
def q_facet_airports(spark, sf_dir):
    return flt.facet_airports(flights(spark, sf_dir))


@register("stored_date_bounds", with_base("SELECT min(fl_date) AS min_date, max(fl_date) AS max_date FROM flights"))
def q_stored_date_bounds(spark, sf_dir):
    """P6 on the table stored by months: the dates of its outermost months alone."""
    path = scratch_path(spark, f"bounds-{uuid.uuid4().hex}")
    files.write_flights(flights(spark, sf_dir), path)
    return spark.createDataFrame([files.stored_bounds(spark, path)], "min_date date, max_date date")


@register("page_flights", _projection_sql("", "ORDER BY flight_id LIMIT 50 OFFSET 100"))
def q_page_flights(spark, sf_dir):
    return flt.page(flt.flight_projection(flights(spark, sf_dir)), "flight_id", page_no=3, size=50)


_DEEP = """
SELECT flight_id, op_carrier, tail_num, fl_date FROM (
  SELECT *, row_number() OVER (ORDER BY op_carrier NULLS FIRST, fl_date NULLS FIRST, tail_num NULLS FIRST, flight_id) AS r,
         count(*) OVER () AS n FROM flights)
WHERE r > n * 9 // 10 // 100 * 100 AND r <= n * 9 // 10 // 100 * 100 + 100"""


@register("page_flights_deep", with_base(_DEEP))
def q_page_flights_deep(spark, sf_dir):
    """a page at nine tenths of the table in the order of carrier, day and tail number, which repeat."""
    rows = cut_lineage(flights(spark, sf_dir).select("op_carrier", "fl_date", "tail_num", "flight_id"))
    return flt.page(rows, ["op_carrier", "fl_date", "tail_num"], rows.count() * 9 // 10 // 100 + 1, 100)


@register("page_flights_by_airline", _projection_sql("WHERE op_carrier_airline_id = 19001",
                                                     "ORDER BY flight_id LIMIT 20 OFFSET 20"))
def q_page_flights_by_airline(spark, sf_dir):
    f = flt.flights_of_airline(flights(spark, sf_dir), 19001)
    return flt.page(flt.flight_projection(f), "flight_id", page_no=2, size=20)


@register("page_airlines", with_base("""
SELECT op_carrier_airline_id AS airline_id, min(op_unique_carrier) AS unique_carrier
FROM flights WHERE op_carrier_airline_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10"""))
def q_page_airlines(spark, sf_dir):
    return flt.page(mdl.build_airlines(flights(spark, sf_dir)), "airline_id", page_no=2, size=10)


@register("list_airports", with_base("SELECT * FROM airports"))
def q_list_airports(spark, sf_dir):
    """the airports table as built from the flight records."""
    return mdl.build_airports(mdl.canonical_columns(_raw(spark, sf_dir)))


@register("sample_flights", with_base("""
SELECT flight_id, fl_date, op_carrier FROM flights, win WHERE fl_date BETWEEN CAST(win.s AS DATE) AND win.e
ORDER BY flight_id LIMIT 1000""", WINDOW_CTE))
def q_sample_flights(spark, sf_dir):
    f = flights(spark, sf_dir)
    w = flt.window_from_bounds(f)
    return flt.sample_flights(flt.between_dates(f, w.start, w.end), limit=1000).select("flight_id", "fl_date", "op_carrier")
