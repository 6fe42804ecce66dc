"""Catalog entries for free-form SQL (Q1-Q4) and the conformance queries.

Each conformance query runs through ``run_select`` over the temp views
``flights``, ``airports``, ``airlines`` (and ``events`` where needed). Most texts
are portable and used verbatim as the oracle; where the dialects differ
(arrays, JSON) the DuckDB text is written separately.

The cross-join conformance query is not registered: jobs here do not build
cartesian products. ``run_select`` still accepts CROSS JOIN from a user.
"""

from __future__ import annotations

import uuid

from airmetrics.operators import modelling as mdl
from airmetrics.operators.sqlgate import run_select, select_to_csv
from airmetrics.plans.catalog import airports, flights, register
from airmetrics.plans.oracle_sql import with_base
from airmetrics.session import scratch_path
from airmetrics.sources import fixtures as fx

AIRLINES_CTE = """airlines AS (
  SELECT op_carrier_airline_id AS airline_id, min(op_unique_carrier) AS unique_carrier
  FROM flights WHERE op_carrier_airline_id IS NOT NULL GROUP BY 1)"""


def _tables(spark, sf_dir, events: bool = False):
    f = flights(spark, sf_dir)
    t = {"flights": f, "airports": airports(spark, sf_dir), "airlines": mdl.build_airlines(f)}
    if events:
        t["events"] = fx.table(spark, sf_dir, "events")
    return t


def sql_query(name: str, spark_sql: str, duck_sql: str | None = None, events: bool = False):
    """Register a query that runs ``spark_sql`` via run_select; oracle = duck_sql or the same text."""
    oracle = with_base(duck_sql or spark_sql, AIRLINES_CTE)

    def run(spark, sf_dir):
        return run_select(spark, _tables(spark, sf_dir, events), spark_sql)

    register(name, oracle)(run)


sql_query("run_select", """
SELECT op_carrier, count(*) AS n_flights, sum(CASE WHEN cancelled THEN 1 ELSE 0 END) AS n_cancelled
FROM flights GROUP BY op_carrier;""")

sql_query("sql_joins_outer", """
SELECT 'left' AS kind, al.airline_id AS id, c.n AS n
FROM airlines al LEFT JOIN (
  SELECT op_carrier_airline_id AS id, count(*) AS n FROM flights WHERE cancelled GROUP BY op_carrier_airline_id) c
  ON al.airline_id = c.id
UNION ALL
SELECT 'right', a.airport_id, d.n
FROM (SELECT dest_airport_id AS id, count(*) AS n FROM flights WHERE diverted GROUP BY dest_airport_id) d
  RIGHT JOIN airports a ON a.airport_id = d.id
UNION ALL
SELECT 'full', coalesce(al.airline_id, x.id), x.n
FROM airlines al FULL OUTER JOIN (
  SELECT origin_airport_id AS id, count(*) AS n FROM flights GROUP BY origin_airport_id) x
  ON al.airline_id = x.id""")

sql_query("sql_join_semi_anti", """
SELECT 'semi' AS kind, al.airline_id FROM airlines al
WHERE EXISTS (SELECT 1 FROM flights f WHERE f.op_carrier_airline_id = al.airline_id AND f.cancelled)
UNION ALL
SELECT 'anti', al.airline_id FROM airlines al
WHERE NOT EXISTS (SELECT 1 FROM flights f WHERE f.op_carrier_airline_id = al.airline_id AND f.cancelled)""")

sql_query("sql_join_range", """
WITH m AS (
  SELECT year(fl_date) AS y, month(fl_date) AS mo, min(fl_date) AS d0, max(fl_date) AS d1
  FROM flights WHERE fl_date IS NOT NULL GROUP BY year(fl_date), month(fl_date))
SELECT m.y, m.mo, count(*) AS n, sum(f.arr_delay) AS total_delay
FROM flights f JOIN m ON year(f.fl_date) = m.y AND f.fl_date BETWEEN m.d0 AND m.d1
GROUP BY m.y, m.mo""")

sql_query("sql_subquery", """
WITH carrier_avg AS (
  SELECT op_carrier, avg(arr_delay) AS a FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier)
SELECT c.op_carrier, c.a AS avg_delay,
       (SELECT max(f.arr_delay) FROM flights f WHERE f.op_carrier = c.op_carrier) AS max_delay,
       c.a - (SELECT avg(arr_delay) FROM flights) AS diff_from_all
FROM carrier_avg c
WHERE c.a > (SELECT min(a) FROM carrier_avg)
  AND c.op_carrier IN (SELECT op_carrier FROM flights WHERE diverted)""")

sql_query("sql_group_having_distinct", """
SELECT op_carrier, count(DISTINCT dest_airport_id) AS n_dest,
       count(*) FILTER (WHERE diverted) AS n_diverted, sum(distance) AS total_distance
FROM flights GROUP BY op_carrier HAVING count(*) > 100""")

sql_query("sql_grouping_sets", """
SELECT op_carrier, cancelled, CAST(grouping(op_carrier) AS INT) AS g_carrier,
       CAST(grouping(cancelled) AS INT) AS g_cancelled, count(*) AS n
FROM flights GROUP BY GROUPING SETS ((op_carrier, cancelled), (op_carrier), ())""")

sql_query("sql_rollup", """
SELECT year(fl_date) AS y, month(fl_date) AS m, count(*) AS n, sum(arr_delay) AS total_delay
FROM flights GROUP BY ROLLUP (year(fl_date), month(fl_date))""")

sql_query("sql_cube", """
SELECT op_carrier, diverted, count(*) AS n, sum(air_time) AS total_air_time
FROM flights GROUP BY CUBE (op_carrier, diverted)""")

sql_query("sql_window_rank", """
SELECT op_carrier, fl_date, n,
       rank() OVER (PARTITION BY op_carrier ORDER BY n DESC, fl_date) AS rk,
       row_number() OVER (PARTITION BY op_carrier ORDER BY fl_date) AS rn,
       lag(n) OVER (PARTITION BY op_carrier ORDER BY fl_date) AS prev_n,
       lead(n, 2) OVER (PARTITION BY op_carrier ORDER BY fl_date) AS next2_n
FROM (SELECT op_carrier, fl_date, count(*) AS n FROM flights
      WHERE fl_date IS NOT NULL AND op_carrier IS NOT NULL GROUP BY op_carrier, fl_date) t""")

sql_query("sql_window_frame", """
SELECT op_carrier, fl_date, n,
       sum(n) OVER (PARTITION BY op_carrier ORDER BY fl_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n_last3,
       sum(n) OVER (PARTITION BY op_carrier ORDER BY fl_date
                    RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS n_7days,
       sum(n) OVER (PARTITION BY op_carrier ORDER BY fl_date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_running
FROM (SELECT op_carrier, fl_date, count(*) AS n FROM flights
      WHERE fl_date IS NOT NULL AND op_carrier IS NOT NULL GROUP BY op_carrier, fl_date) t""")

sql_query("sql_set_ops", """
SELECT 'union' AS op, CAST(id AS VARCHAR(20)) AS value FROM (
  SELECT origin_airport_id AS id FROM flights UNION SELECT dest_airport_id FROM flights) u
UNION ALL
SELECT 'union_all_count', CAST(count(*) AS VARCHAR(20)) FROM (
  SELECT origin_airport_id FROM flights UNION ALL SELECT dest_airport_id FROM flights) ua
UNION ALL
SELECT 'intersect', op_carrier FROM (
  SELECT op_carrier FROM flights WHERE cancelled INTERSECT SELECT op_carrier FROM flights WHERE diverted) i
UNION ALL
SELECT 'except', op_carrier FROM (
  SELECT op_carrier FROM flights EXCEPT SELECT op_carrier FROM flights WHERE cancelled) e""")

sql_query("sql_order_limit", """
SELECT flight_id, fl_date, arr_delay FROM flights
ORDER BY fl_date ASC NULLS FIRST, arr_delay DESC NULLS LAST, flight_id LIMIT 20 OFFSET 5""")

sql_query("sql_string_fns", """
SELECT DISTINCT op_carrier, lower(op_carrier) AS lo, upper(op_carrier) AS up,
       CAST(length(op_carrier) AS INT) AS len, substr(op_carrier, 1, 5) AS pre,
       replace(op_carrier, 'Brand#', 'B') AS short, lpad(split_part(op_carrier, '#', 2), 3, '0') AS num,
       concat(op_carrier, '/', CAST(op_carrier_airline_id AS VARCHAR(10))) AS joined,
       CAST(position('#' IN op_carrier) AS INT) AS hash_pos, reverse(op_carrier) AS rev,
       trim('  ' || op_carrier || '  ') AS trimmed, op_carrier LIKE 'Brand#1%' AS like1
FROM flights WHERE op_carrier IS NOT NULL""")

sql_query("sql_date_fns", """
SELECT DISTINCT fl_date, CAST(year(fl_date) AS INT) AS y, CAST(quarter(fl_date) AS INT) AS q,
       CAST(month(fl_date) AS INT) AS m, CAST(dayofmonth(fl_date) AS INT) AS d,
       CAST(weekofyear(fl_date) AS INT) AS wk, CAST(extract(doy FROM fl_date) AS INT) AS doy,
       last_day(fl_date) AS eom, make_date(year(fl_date), month(fl_date), 1) AS som,
       CAST(date_trunc('year', fl_date) AS DATE) AS soy
FROM flights WHERE fl_date IS NOT NULL""")

sql_query("sql_math_fns", """
SELECT op_carrier, round(avg(arr_delay), 3) AS r3, CAST(floor(avg(arr_delay)) AS DOUBLE) AS fl,
       CAST(ceil(avg(arr_delay)) AS DOUBLE) AS ce, abs(min(arr_delay)) AS ab, sqrt(sum(distance)) AS sq,
       power(2.0, 10) AS pw, round(ln(sum(distance)), 9) AS lg, sign(min(arr_delay)) AS sg,
       greatest(min(arr_delay), -5.0) AS gr, least(max(arr_delay), 5.0) AS le,
       CAST(max(op_carrier_airline_id) % 7 AS INT) AS md
FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier""")

sql_query("sql_case_null_fns", """
SELECT flight_id,
       CASE WHEN arr_delay IS NULL THEN 'none' WHEN arr_delay > 15 THEN 'late'
            WHEN arr_delay < 0 THEN 'early' ELSE 'on_time' END AS status,
       coalesce(arr_delay, dep_delay, -999.0) AS delay_or_default,
       nullif(op_carrier_airline_id, 19001) AS airline_or_null,
       (cancelled IS DISTINCT FROM diverted) AS one_flag
FROM flights""")

sql_query("sql_array_json_fns", """
SELECT op_carrier,
       array_join(array_sort(collect_set(CAST(dest_airport_id AS STRING))), ',') AS dests,
       size(collect_set(dest_airport_id)) AS n_dests,
       sum(CAST(get_json_object(concat('{"d":', CAST(CAST(distance AS INT) AS STRING), '}'), '$.d') AS INT)) AS json_dist
FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier""", """
SELECT op_carrier,
       array_to_string(list_sort(list_distinct(array_agg(CAST(dest_airport_id AS VARCHAR)))), ',') AS dests,
       CAST(count(DISTINCT dest_airport_id) AS INT) AS n_dests,
       CAST(sum(CAST(json_extract_string('{"d":' || CAST(CAST(distance AS INT) AS VARCHAR) || '}', '$.d') AS INT)) AS BIGINT) AS json_dist
FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier""")

sql_query("sql_json_events", """
SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS INT)) AS k_sum
FROM events GROUP BY event_type""", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS INT)) AS k_sum
FROM events GROUP BY event_type""", events=True)

sql_query("sql_stat_fns", """
SELECT op_carrier, round(stddev_samp(arr_delay), 9) AS sd, round(var_pop(dep_delay), 9) AS vp,
       round(corr(distance, air_time), 9) AS r, round(regr_slope(air_time, distance), 9) AS slope,
       round(regr_intercept(air_time, distance), 9) AS icpt, CAST(regr_count(air_time, distance) AS BIGINT) AS n
FROM flights WHERE op_carrier IS NOT NULL GROUP BY op_carrier""")


@register("select_to_csv", with_base("""
SELECT op_carrier, CAST(count(*) AS BIGINT) AS n_flights FROM flights WHERE op_carrier IS NOT NULL
GROUP BY op_carrier""", AIRLINES_CTE))
def q_select_to_csv(spark, sf_dir):
    """Q4: query -> CSV file -> read back with an explicit schema."""
    path = scratch_path(spark, f"select-csv-{uuid.uuid4().hex}")
    select_to_csv(spark, _tables(spark, sf_dir),
                  "select op_carrier, count(*) as n_flights from flights where op_carrier is not null "
                  "group by op_carrier", path, single=True)
    return spark.read.schema("op_carrier string, n_flights bigint").option("header", True).csv(path)
