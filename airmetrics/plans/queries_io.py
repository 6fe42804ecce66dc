"""Catalog entries for sources and sinks (S1-S11) and the LOWESS curve."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.operators import charts as ch
from airmetrics.operators import modelling as mdl
from airmetrics.operators.joins import flights_with_airports
from airmetrics.operators.lowess import lowess
from airmetrics.plans import dashboard as dash
from airmetrics.plans import day_charts
from airmetrics.plans.catalog import airports, flights, register
from airmetrics.plans.oracle_sql import with_base
from airmetrics.schemas import FLIGHT_COLUMNS, SOURCE_TO_CANONICAL
from airmetrics.session import scratch_path, stored
from airmetrics.sources import buckets, files, ledger
from airmetrics.sources import fixtures as fx
from airmetrics.sources import tables as tbl

_ALL = ", ".join(FLIGHT_COLUMNS)


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _lowess_sql(iterations: int = 3, frac: str = "0.6666666") -> str:
    """The LOWESS definition in SQL on the (small) distinct-x grid, with the
    robustness passes unrolled. All pairs of distinct values are formed here,
    which is fine for an oracle on a test table."""
    def fit(name: str, grid: str) -> str:
        return f"""
ss{name} AS (SELECT p.x0, p.c0, sum(p.w * q.c) AS W, sum(p.w * q.c * p.x) AS Sx, sum(p.w * q.c * p.x * p.x) AS Sxx,
                    sum(p.w * q.sy) AS Sy, sum(p.w * p.x * q.sy) AS Sxy
             FROM ww p JOIN {grid} q ON p.x = q.x GROUP BY p.x0, p.c0),
fit{name} AS (SELECT x0, c0, CASE WHEN W <= 0 THEN NULL
    WHEN (Sxx / W - (Sx / W) * (Sx / W)) > 1e-9 * ((Sx / W) * (Sx / W) + 1.0)
    THEN Sy / W + (x0 - Sx / W) * (Sxy / W - (Sx / W) * (Sy / W)) / (Sxx / W - (Sx / W) * (Sx / W))
    ELSE Sy / W END AS fitted FROM ss{name})"""

    ctes = [f"""
pts AS (SELECT distance AS x, air_time AS y FROM flights WHERE distance IS NOT NULL AND air_time IS NOT NULL),
g0 AS (SELECT x, CAST(count(*) AS DOUBLE) AS c, sum(y) AS sy FROM pts GROUP BY x),
kk AS (SELECT greatest(1, CAST(floor({frac} * count(*) + 1e-10) AS BIGINT)) AS k FROM pts),
pr AS (SELECT a.x AS x0, a.c AS c0, b.x, b.c, abs(b.x - a.x) AS d FROM g0 a, g0 b),
cu AS (SELECT x0, d, sum(c) OVER (PARTITION BY x0 ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc
       FROM pr),
hh AS (SELECT x0, min(d) AS h FROM cu, kk WHERE cc >= k GROUP BY x0),
ww AS (SELECT p.x0, CAST(p.c0 AS BIGINT) AS c0, p.x,
         CASE WHEN hh.h = 0 THEN 1.0 ELSE
           (1.0 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h)) * (1.0 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h))
           * (1.0 - (p.d / hh.h) * (p.d / hh.h) * (p.d / hh.h)) END AS w
       FROM pr p JOIN hh ON p.x0 = hh.x0 WHERE p.d < hh.h OR p.d = 0)""", fit("0", "g0")]
    for i in range(1, iterations + 1):
        ctes.append(f"""
res{i} AS (SELECT p.x, p.y, abs(p.y - coalesce(f.fitted, p.y)) AS r FROM pts p JOIN fit{i - 1} f ON p.x = f.x0),
med{i} AS (SELECT quantile_cont(r, 0.5) AS m FROM res{i}),
g{i} AS (SELECT x, sum(d) AS c, sum(d * y) AS sy FROM (
  SELECT x, y, CASE WHEN m = 0 THEN (CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END)
                    WHEN r / (6.0 * m) >= 1 THEN 0.0
                    ELSE (1.0 - (r / (6.0 * m)) * (r / (6.0 * m))) * (1.0 - (r / (6.0 * m)) * (r / (6.0 * m))) END AS d
  FROM res{i}, med{i}) t GROUP BY x)""")
        ctes.append(fit(str(i), f"g{i}"))
    body = f"SELECT x0 AS distance, c0 AS n, round(fitted, 6) AS fitted FROM fit{iterations}"
    return with_base(body, ",".join(ctes))


@register("distance_airtime_lowess", _lowess_sql())
def q_distance_airtime_lowess(spark, sf_dir):
    """A9 curve with the reference's options (span 0.6666666, 3 robustness passes)."""
    return lowess(ch.distance_airtime_pairs(flights(spark, sf_dir)), "distance", "air_time")


@register("distance_airtime_lowess_plain", _lowess_sql(iterations=0))
def q_distance_airtime_lowess_plain(spark, sf_dir):
    """A9 curve without robustness passes (one local linear fit per distinct x)."""
    return lowess(ch.distance_airtime_pairs(flights(spark, sf_dir)), "distance", "air_time", iterations=0)


@register("csv_round_trip", with_base(f"SELECT {_ALL} FROM flights"))
def q_csv_round_trip(spark, sf_dir):
    """S2 then S1: raw records to CSV under the source's names, in foreign order and with
    columns that are not kept; read back by name as text, cleaned (C11)."""
    raw = fx.flights_raw(spark, sf_dir)
    path = _fresh(spark, "raw-csv")
    wide = raw.withColumnsRenamed({c: name for name, c in SOURCE_TO_CANONICAL.items()})
    files.write_csv(wide.select(*reversed(wide.columns)), path, compression="gzip")
    return mdl.build_flights(files.read_flights_csv(spark, path))


@register("append_round_trip", with_base(f"SELECT {_ALL} FROM flights"))
def q_append_round_trip(spark, sf_dir):
    """Two appends into a month-partitioned parquet table, read back."""
    f = files.with_month(flights(spark, sf_dir))
    early = F.col("fl_date") < F.lit("1998-01-01").cast("date")
    path = _fresh(spark, "flights-append")
    files.append_table(f.where(early), path, ["fl_month"])
    files.append_table(f.where(~F.coalesce(early, F.lit(False))), path, ["fl_month"])
    return spark.read.parquet(path).select(*FLIGHT_COLUMNS)


UPSERT_SQL = with_base("""
SELECT * FROM airports a
WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.airport_id = a.airport_id AND u.airport_seq_id = a.airport_seq_id)
UNION ALL SELECT * FROM upd""", """
upd AS (
  SELECT airport_id, airport_seq_id, city_market_id, code, lower(city_name) AS city_name, state_abr, state_fips,
         state_name, wac FROM airports WHERE state_name <> 'ASIA'
  UNION ALL
  SELECT airport_id, airport_seq_id + 50, city_market_id, code, city_name, state_abr, state_fips, state_name, wac
  FROM airports WHERE state_name = 'AMERICA')""")


def _built_airports(spark, sf_dir):
    """The airports table built from the flight records."""
    return mdl.build_airports(mdl.canonical_columns(fx.flights_raw(spark, sf_dir)))


def _airport_updates(a):
    changed = a.where(F.col("state_name") != "ASIA").withColumn("city_name", F.lower("city_name"))
    new = a.where(F.col("state_name") == "AMERICA").withColumn("airport_seq_id", F.col("airport_seq_id") + 50)
    return changed.unionByName(new)


@register("upsert_airports", UPSERT_SQL)
def q_upsert_airports(spark, sf_dir):
    """Replace changed airports, insert new sequence rows, write to a new path."""
    a = _built_airports(spark, sf_dir)
    path = tbl.upsert_to_new_path(spark, a, _airport_updates(a), ["airport_id", "airport_seq_id"],
                                  _fresh(spark, "airports"))
    return spark.read.parquet(path)


@register("upsert_airports_twice", UPSERT_SQL)
def q_upsert_airports_twice(spark, sf_dir):
    """S5 is idempotent: applying the same updates twice equals applying them once."""
    a = _built_airports(spark, sf_dir)
    u = _airport_updates(a)
    once = tbl.upsert(a, u, ["airport_id", "airport_seq_id"])
    return tbl.upsert(once, u, ["airport_id", "airport_seq_id"])


@register("upsert_flights_buckets", with_base("""
SELECT flight_id, op_carrier, fl_date, distance + CASE WHEN flight_id % 50 = 0 THEN 1 ELSE 0 END AS distance FROM flights
UNION ALL SELECT -flight_id, op_carrier, fl_date, distance FROM flights WHERE flight_id % 70 = 0"""))
def q_upsert_flights_buckets(spark, sf_dir):
    """Changed and new flights put twice into a bucketed table."""
    rows = flights(spark, sf_dir).select("flight_id", "op_carrier", "fl_date", "distance")
    updates = rows.where("flight_id % 50 = 0").withColumn("distance", F.col("distance") + 1).unionByName(
        rows.where("flight_id % 70 = 0").withColumn("flight_id", -F.col("flight_id")))
    path = _fresh(spark, "flight-buckets")
    buckets.create(rows, path, ["flight_id"], 16)
    for _ in range(2):
        buckets.upsert(updates, path, rows.schema, ["flight_id"])
    return buckets.table(spark, path, rows.schema)


# The previous load stopped at the middle of the key range.
HIGH_WATER_CTE = "hw AS (SELECT min(flight_id) + (max(flight_id) - min(flight_id)) // 2 AS m FROM flights)"


def _incremental(spark, sf_dir):
    f = flights(spark, sf_dir)
    b = f.agg(F.min("flight_id").alias("lo"), F.max("flight_id").alias("hi")).first()
    return tbl.incremental_append(f, b["lo"] + (b["hi"] - b["lo"]) // 2)


@register("incremental_flights", with_base("""
SELECT flight_id, fl_date, op_carrier FROM flights, hw
WHERE flight_id > hw.m AND fl_date IS NOT NULL AND op_carrier IS NOT NULL AND origin_airport_id IS NOT NULL
  AND dest_airport_id IS NOT NULL AND crs_dep_time IS NOT NULL""", HIGH_WATER_CTE))
def q_incremental_flights(spark, sf_dir):
    return _incremental(spark, sf_dir)[0].select("flight_id", "fl_date", "op_carrier")


@register("rejected_rows", with_base("""
SELECT flight_id, CASE WHEN fl_date IS NULL THEN 'fl_date missing or unparseable'
                       WHEN op_carrier IS NULL THEN 'op_carrier missing'
                       WHEN origin_airport_id IS NULL OR dest_airport_id IS NULL THEN 'airport id missing'
                       ELSE 'crs_dep_time missing or invalid' END AS error
FROM flights, hw
WHERE flight_id > hw.m AND (fl_date IS NULL OR op_carrier IS NULL OR origin_airport_id IS NULL
  OR dest_airport_id IS NULL OR crs_dep_time IS NULL)""", HIGH_WATER_CTE))
def q_rejected_rows(spark, sf_dir):
    return _incremental(spark, sf_dir)[1].select("flight_id", "error")


_NO_KEY = [c for c in FLIGHT_COLUMNS if c != "flight_id"]


def _two_loads(spark, sf_dir) -> tuple[str, str]:
    """S6 for records without a key: a first load of the early rows, then one of the whole
    source; each takes what the stored rows lack. Returns the folders of (valid, rejected)."""
    source = stored(mdl.build_flights(fx.flights_raw(spark, sf_dir).drop("FLIGHT_ID")).drop("flight_id"), "load-source")
    valid_path, rejected_path = _fresh(spark, "loads-valid"), _fresh(spark, "loads-rejected")
    loaded, last = None, 0
    for batch in (source.where(F.col("fl_date") < F.lit("1998-01-01").cast("date")), source):
        valid, rejected = tbl.incremental_append(batch, loaded=loaded)
        files.append_table(tbl.with_unique_id(valid, last), valid_path)
        files.append_table(rejected, rejected_path)
        taken = spark.read.parquet(valid_path)
        loaded = taken.select(*_NO_KEY).union(spark.read.parquet(rejected_path).select(*_NO_KEY))
        last = tbl.high_water_mark(taken) or 0
    return valid_path, rejected_path


@register("incremental_loads", with_base(f"""
SELECT {", ".join(_NO_KEY)}, CASE WHEN fl_date IS NULL THEN 'fl_date missing or unparseable'
       WHEN op_carrier IS NULL THEN 'op_carrier missing'
       WHEN origin_airport_id IS NULL OR dest_airport_id IS NULL THEN 'airport id missing'
       WHEN crs_dep_time IS NULL THEN 'crs_dep_time missing or invalid' END AS error
FROM flights"""))
def q_incremental_loads(spark, sf_dir):
    """After both loads every record is stored exactly once, as valid or with its error."""
    valid_path, rejected_path = _two_loads(spark, sf_dir)
    valid = spark.read.parquet(valid_path).select(*_NO_KEY, F.lit(None).cast("string").alias("error"))
    return valid.union(spark.read.parquet(rejected_path).select(*_NO_KEY, "error"))


_DELIVERIES = [("a.csv", "fl_date < DATE '1993-01-01'"), ("b.csv", "fl_date >= DATE '1994-01-01' AND fl_date < DATE '1996-01-01'"),
               ("c.csv", "fl_date >= DATE '1996-01-01' AND fl_date < DATE '1997-01-01'"),
               ("a.csv", "fl_date < DATE '1994-01-01' OR fl_date IS NULL"), ("d.csv", "fl_date >= DATE '1997-01-01'")]


def _five_loads(spark, sf_dir) -> str:
    """Five deliveries; the fourth is the first one again, with further rows."""
    source = stored(flights(spark, sf_dir).select(*_NO_KEY), "deliveries")  # the five read it six times
    path = _fresh(spark, "ledger")
    for name, rows in _DELIVERIES:
        ledger.load(source.where(rows), name, path)
    return path


@register("ledger_loads", with_base(f"""
SELECT {", ".join(_NO_KEY)}, CASE WHEN fl_date IS NULL THEN 'fl_date missing or unparseable'
       WHEN op_carrier IS NULL THEN 'op_carrier missing'
       WHEN origin_airport_id IS NULL OR dest_airport_id IS NULL THEN 'airport id missing'
       WHEN crs_dep_time IS NULL THEN 'crs_dep_time missing or invalid' END AS error
FROM flights"""))
def q_ledger_loads(spark, sf_dir):
    """After five loads every record is stored exactly once, as valid or with its error."""
    path = _five_loads(spark, sf_dir)
    return ledger.loaded(spark, path, flights(spark, sf_dir).select(*_NO_KEY).schema).select(*_NO_KEY, "error")


@register("load_ledger", with_base("""
SELECT CAST(load_id AS BIGINT) AS load_id, source, count(*) FILTER (read) AS n_read, count(*) FILTER (read AND known) AS n_compared,
       count(*) FILTER (read AND NOT known) AS n_new, count(*) FILTER (read AND NOT known AND valid) AS n_valid,
       count(*) FILTER (read AND NOT known AND NOT valid) AS n_rejected
FROM (SELECT *, fl_date IS NOT NULL AND op_carrier IS NOT NULL AND origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL
             AND crs_dep_time IS NOT NULL AS valid FROM flights) f,
     LATERAL (VALUES """ + ", ".join(
    f"({i + 1}, '{name}', coalesce({rows}, false), " + (f"coalesce({_DELIVERIES[0][1]}, false)" if i == 3 else "false") + ")"
    for i, (name, rows) in enumerate(_DELIVERIES)) + """) d(load_id, source, read, known)
GROUP BY load_id, source"""))
def q_load_ledger(spark, sf_dir):
    """What each load read, compared and took."""
    return ledger.ledger(spark, _five_loads(spark, sf_dir))


@register("unique_flight_ids", with_base("""
SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id FROM flights
WHERE fl_date IS NOT NULL AND op_carrier IS NOT NULL AND origin_airport_id IS NOT NULL
  AND dest_airport_id IS NOT NULL AND crs_dep_time IS NOT NULL"""))
def q_unique_flight_ids(spark, sf_dir):
    """The numbers given over two loads are unique and without gaps."""
    stored = spark.read.parquet(_two_loads(spark, sf_dir)[0])
    per_id = stored.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
                      F.min("flight_id").alias("first_id"), F.max("flight_id").alias("last_id"))


_JSON_COLS = ", ".join("strftime(fl_date, '%Y-%m-%d') AS fl_date" if c == "fl_date" else c for c in FLIGHT_COLUMNS)


@register("rows_as_json", with_base(f"SELECT {_JSON_COLS}, CAST({len(FLIGHT_COLUMNS)} AS INTEGER) AS n_keys FROM flights"))
def q_rows_as_json(spark, sf_dir):
    """Every flight row as one JSON object; checked by parsing it back and counting its keys."""
    rows = mdl.normalize_for_export(flights(spark, sf_dir))
    record = files.to_records(rows)
    return record.select(F.from_json("record", rows.schema).alias("r"),
                         F.size(F.json_object_keys("record")).alias("n_keys")).select("r.*", "n_keys")


@register("flights_with_airports", with_base("""
SELECT flight_id, origin_airport_id, airport_seq_id AS origin_airport_seq_id, code AS origin_code, state_name AS origin_state_name
FROM flights JOIN airports1 ON origin_airport_id = airport_id"""))
def q_flights_with_airports(spark, sf_dir):
    """Every flight with its origin airport."""
    return flights_with_airports(flights(spark, sf_dir), airports(spark, sf_dir)).select(
        "flight_id", "origin_airport_id", "origin_airport_seq_id", "origin_code", "origin_state_name")


@register("materialized_chart", with_base("""
SELECT op_carrier, flights, flights / sum(flights) OVER () AS share FROM (
  SELECT op_carrier, count(*) AS flights FROM flights, win
  WHERE op_carrier IS NOT NULL AND fl_date BETWEEN CAST(win.s AS DATE) AND win.e
  GROUP BY op_carrier ORDER BY flights DESC, op_carrier LIMIT 10) t""",
    "win AS (SELECT max(fl_date) - INTERVAL 365 DAY AS s, max(fl_date) AS e FROM flights)"))
def q_materialized_chart(spark, sf_dir):
    """All default charts stored once; one of them read back."""
    base = _fresh(spark, "dashboard")
    paths = dash.materialize_dashboard(flights(spark, sf_dir), airports(spark, sf_dir), base)
    return spark.read.parquet(paths["flight_counts"])


@register("dashboard_filtered_counts", with_base("""
SELECT op_carrier, flights, flights / sum(flights) OVER () AS share FROM (
  SELECT op_carrier, count(*) AS flights FROM flights, win
  WHERE op_carrier IS NOT NULL AND fl_date BETWEEN CAST(win.s AS DATE) AND win.e
    AND op_carrier IN ('Brand#1', 'Brand#2', 'Brand#3') AND (origin_airport_id = 10003 OR dest_airport_id = 10003)
  GROUP BY op_carrier ORDER BY flights DESC, op_carrier LIMIT 10) t""",
    "win AS (SELECT max(fl_date) - INTERVAL 365 DAY AS s, max(fl_date) AS e FROM flights)"))
def q_dashboard_filtered_counts(spark, sf_dir):
    """The dashboard request end to end (window, carrier and airport filters,
    single-pass summary); the carrier chart of the result."""
    d = dash.dashboard(flights(spark, sf_dir), airports(spark, sf_dir), airlines=["Brand#1", "Brand#2", "Brand#3"],
                       airport="10003", cache=False, with_lowess=False)
    return d.builders["flight_counts"]()


def _top(name: str, key: str, value: str, where: str = "true", source: str = "wf", limit: bool = True) -> str:
    return (f"SELECT * FROM (SELECT '{name}' AS chart, CAST({key} AS VARCHAR) AS key, CAST({value} AS DOUBLE) AS value FROM {source} "
            f"WHERE {where} GROUP BY {key} HAVING {value} IS NOT NULL" + (f" ORDER BY {value} DESC, 2 LIMIT 10)" if limit else ")"))


_ROUTE = "CAST(origin_airport_id AS VARCHAR) || ' → ' || CAST(dest_airport_id AS VARCHAR)"
_DAY_CHARTS = [
    _top("flight_counts", "op_carrier", "count(*)", "op_carrier IS NOT NULL"),
    _top("cancelled_flights", "op_carrier", "count(*)", "cancelled AND op_carrier IS NOT NULL"),
    _top("airtime_by_route", _ROUTE, "avg(air_time)", "air_time IS NOT NULL AND origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL"),
    _top("flights_by_date", "fl_date", "count(*)", limit=False),
    _top("delay_by_hour", "CAST(floor(crs_dep_time / 3600) AS INTEGER)", "avg(arr_delay)", "crs_dep_time IS NOT NULL", limit=False),
    _top("delay_by_airline", "op_carrier", "avg(arr_delay)", "op_carrier IS NOT NULL"),
    _top("cancellation_rate", "op_carrier", "nullif(100.0 * count(*) FILTER (cancelled) / count(*), 0)", "op_carrier IS NOT NULL"),
    _top("most_common_routes", _ROUTE, "count(*)", "origin_airport_id IS NOT NULL AND dest_airport_id IS NOT NULL"),
    _top("delay_by_weekday", "dayname(fl_date)", "avg(arr_delay)", "arr_delay IS NOT NULL", limit=False),
    _top("monthly_delay_trend", "monthname(fl_date)", "avg(arr_delay)", "arr_delay IS NOT NULL", limit=False),
    _top("most_diverted_airports", "dest_airport_id", "count(*)", "diverted AND dest_airport_id IS NOT NULL"),
    _top("delay_by_airport", "origin_airport_id", "avg(arr_delay)", "origin_airport_id IS NOT NULL"),
    _top("delay_by_state", "state_name", "avg(arr_delay)", "state_name IS NOT NULL", "wf JOIN airports1 ON origin_airport_id = airport_id"),
    _top("arrival_delay_histogram", "CAST(floor(arr_delay / w) * w AS BIGINT)", "count(*)", "arr_delay IS NOT NULL", "wf, wd", limit=False),
    _top("distance_airtime_points", "CAST(CAST(distance AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(air_time AS BIGINT) AS VARCHAR)", "count(*)",
         "distance IS NOT NULL AND air_time IS NOT NULL", limit=False),
]
_DAY_KEYS = {"airtime_by_route": "route", "flights_by_date": "fl_date", "delay_by_hour": "hour", "most_common_routes": "route",
             "delay_by_weekday": "weekday", "monthly_delay_trend": "month", "most_diverted_airports": "dest_airport_id",
             "delay_by_airport": "origin_airport_id", "delay_by_state": "state_name"}


def long_charts(found: dict) -> DataFrame:
    """All charts (without the facets) as rows chart, key, value."""
    out = []
    for name, rows in found.items():
        if name == "facets":
            continue
        key = F.col(_DAY_KEYS.get(name, "op_carrier")) if name not in ("arrival_delay_histogram", "distance_airtime_points") else None
        if name == "arrival_delay_histogram":
            key = F.col("bin_start").cast("long")
        elif name == "distance_airtime_points":
            key = F.concat_ws(" ", F.col("distance").cast("long"), F.col("air_time").cast("long"))
        value = next(c for c in rows.columns if c in ("flights", "cancelled_count", "avg_air_time", "n_flights", "avg_delay", "avg_arr_delay",
                                                      "cancel_rate_pct", "diverted_count", "arr_delay", "mean_delay", "n"))
        out.append(rows.select(F.lit(name).alias("chart"), key.cast("string").alias("key"), F.col(value).cast("double").alias("value")))
    return reduce(DataFrame.union, out)


@register("day_charts_after_loads", with_base(" UNION ALL ".join(_DAY_CHARTS), """
win AS (SELECT max(fl_date) - INTERVAL 500 DAY AS s, max(fl_date) - INTERVAL 100 DAY AS e FROM flights),
wf AS (SELECT f.* FROM flights f, win WHERE fl_date BETWEEN CAST(win.s AS DATE) AND CAST(win.e AS DATE)),
bounds AS (SELECT min(arr_delay) AS lo, max(arr_delay) AS hi FROM wf),
cand AS (SELECT lo, hi, (hi - lo) / 49.0 AS t, floor(log10((hi - lo) / 49.0)) AS k FROM bounds WHERE hi > lo),
wd AS (SELECT coalesce((SELECT min(m * pow(10.0, k + e)) FROM cand, (VALUES (1.0), (2.0), (5.0)) ms(m), (VALUES (-1), (0), (1)) es(e)
                        WHERE m * pow(10.0, k + e) >= t), 1.0) AS w)"""))
def q_day_charts_after_loads(spark, sf_dir):
    """Day sums of a first load, then of a second one, merged to the charts of a window of 400 days."""
    path, rows = _fresh(spark, "day-charts"), flights(spark, sf_dir)
    day_charts.add(rows.where("flight_id % 3 <> 0"), path, "load-1")
    day_charts.add(rows.where("flight_id % 3 = 0"), path, "load-2")
    columns = day_charts.schema(rows)
    last = day_charts.bounds(spark, path, columns)[1]
    start, end = (last - dt.timedelta(days=n) for n in (500, 100))
    return long_charts(day_charts.charts(spark, path, airports(spark, sf_dir), columns, "load-2", start, end))
