"""DuckDB oracle texts.

The CTEs below derive the clean flight tables straight from the driver tables
(no text round trip), so a Spark query that parses the dirty raw form is
checked against values computed another way. Every computed column is cast
explicitly, because integer/double result types differ between the engines.
"""

from __future__ import annotations


def clock_sql(minute_expr: str) -> str:
    return (f"CAST(CASE ok % 101 WHEN 0 THEN 86399 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL "
            f"ELSE (pk % 24) * 3600 + ({minute_expr}) * 60 END AS INTEGER)")


BASE_CTES = f"""
fx AS (
  SELECT l.l_orderkey AS ok, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_linenumber AS ln,
         l.l_quantity AS qty, l.l_returnflag AS rf, l.l_shipdate AS ship, p.p_brand AS brand,
         CAST(split_part(p.p_brand, '#', 2) AS INTEGER) AS b,
         s.s_nationkey AS snk, c.c_nationkey AS cnk
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
fz AS (
  SELECT *, (rf = 'R' AND ok % 10 = 0 AND b % 5 <> 0) AS canc, (ok % 37 = 1) AS dive,
         abs(snk - cnk) AS hop
  FROM fx
),
flights AS (
  SELECT
    CAST(((ok * 100000 + pk) * 10000 + sk) * 10 + ln AS BIGINT) AS flight_id,
    CASE WHEN pk % 97 = 5 THEN NULL ELSE CAST(ship AS DATE) END AS fl_date,
    brand AS op_unique_carrier,
    CAST(19000 + b AS INTEGER) AS op_carrier_airline_id,
    brand AS op_carrier,
    'N' || CAST(sk AS VARCHAR) AS tail_num,
    CAST(pk AS VARCHAR) AS op_carrier_fl_num,
    CAST(10000 + snk AS INTEGER) AS origin_airport_id,
    CAST(10000 + cnk AS INTEGER) AS dest_airport_id,
    {clock_sql("sk % 60")} AS crs_dep_time,
    {clock_sql("(sk % 60 + ln) % 60")} AS dep_time,
    CASE WHEN canc THEN NULL ELSE CAST(floor(qty) - 25 AS DOUBLE) END AS dep_delay,
    {clock_sql("(sk % 60 + ln) % 60")} AS wheels_off,
    {clock_sql("(sk % 60 + ln) % 60")} AS wheels_on,
    {clock_sql("(sk % 60 + ln) % 60")} AS crs_arr_time,
    {clock_sql("(sk % 60 + ln) % 60")} AS arr_time,
    CASE WHEN canc OR dive THEN NULL ELSE CAST(floor(qty) - 20 AS DOUBLE) END AS arr_delay,
    canc AS cancelled,
    dive AS diverted,
    CASE WHEN canc THEN NULL ELSE CAST(30 + 18 * hop + ln AS DOUBLE) END AS air_time,
    CAST(100 + 150 * hop AS DOUBLE) AS distance,
    CAST(1.0 AS DOUBLE) AS flights
  FROM fz
),
airports AS (
  SELECT CAST(10000 + n_nationkey AS INTEGER) AS airport_id,
         CAST((10000 + n_nationkey) * 100 + sq.s AS INTEGER) AS airport_seq_id,
         CAST(30000 + n_nationkey AS VARCHAR) AS city_market_id,
         n_name AS code, n_name AS city_name, substr(r_name, 1, 2) AS state_abr,
         CAST(n_regionkey AS VARCHAR) AS state_fips, r_name AS state_name,
         CAST(n_regionkey AS INTEGER) AS wac
  FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN (VALUES (1), (2)) sq(s) ON sq.s = 1 OR n_nationkey % 7 = 0
),
airports1 AS (
  SELECT * FROM airports a
  WHERE airport_seq_id = (SELECT max(airport_seq_id) FROM airports b WHERE b.airport_id = a.airport_id)
)"""


def with_base(body: str, extra_ctes: str = "") -> str:
    """``WITH <base ctes>[, <extra>] <body>``."""
    extra = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    text = body.lstrip()
    if text[:5].upper() == "WITH ":  # merge the body's own CTEs into the list
        return f"WITH {BASE_CTES}{extra},\n{text[5:]}"
    return f"WITH {BASE_CTES}{extra}\n{body}"
