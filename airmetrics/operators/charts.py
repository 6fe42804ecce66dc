"""The chart set (A1-A17): each returns the small keyed frame behind one chart.

Shared rules
  * input is the filtered ``flights`` frame (F1-F6);
  * a null group key is dropped, except in A16/A17 (SQL GROUP BY keeps it);
  * a group whose mean is null is dropped;
  * top-n ties are cut by key ascending; top-n is ``orderBy(...).limit(n)``,
    which Spark plans as TakeOrderedAndProject (per-partition top-n, then merge);
  * every aggregate is a hash aggregate with a map-side partial step, so a
    carrier or airport holding a third of all rows is pre-reduced before the
    shuffle and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.functions.clean import hour_of_day, route_label
from airmetrics.operators.joins import DEFAULT_BROADCAST_ROWS, flights_with_airports

TOP_N = 10

# Day and month names in calendar order (Monday first), as the
# reference's charts label and order them.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]


def top_k(df: DataFrame, value: str, keys: list[str], n: int) -> DataFrame:
    """Largest ``value`` first, ties by key ascending (nulls last)."""
    return df.orderBy(F.col(value).desc(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def _mean_by(df: DataFrame, key: Column, key_name: str, value: str, out: str) -> DataFrame:
    return (df.where(key.isNotNull())
            .groupBy(key.alias(key_name))
            .agg(F.avg(value).alias(out))
            .where(F.col(out).isNotNull()))


def _count_by(df: DataFrame, key: Column, key_name: str, out: str) -> DataFrame:
    return df.where(key.isNotNull()).groupBy(key.alias(key_name)).agg(F.count(F.lit(1)).alias(out))


def delay_by_airport(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """A1: mean arrival delay by origin airport, top n -> (origin_airport_id, arr_delay)."""
    g = _mean_by(flights, F.col("origin_airport_id").cast("string"), "origin_airport_id",
                 "arr_delay", "arr_delay")
    return top_k(g, "arr_delay", ["origin_airport_id"], n)


def flight_counts(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """A2: flights per carrier, top n, with each carrier's share of the n shown."""
    top = top_k(_count_by(flights, F.col("op_carrier"), "op_carrier", "flights"), "flights", ["op_carrier"], n)
    # The window runs over at most n rows (after the limit).
    return top.withColumn("share", F.col("flights") / F.sum("flights").over(Window.partitionBy()))


def cancelled_flights(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """A4: cancelled flights per carrier, top n -> (op_carrier, cancelled_count)."""
    g = _count_by(flights.where(F.col("cancelled")), F.col("op_carrier"), "op_carrier", "cancelled_count")
    return top_k(g, "cancelled_count", ["op_carrier"], n)


def _route_groups(flights: DataFrame) -> DataFrame:
    """Group on the two integer ids (cheap hash keys); the label is made per group."""
    return flights.where(F.col("origin_airport_id").isNotNull() & F.col("dest_airport_id").isNotNull())


def airtime_by_route(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """A5: mean air time by route, top n -> (route, avg_air_time)."""
    g = (_route_groups(flights).where(F.col("air_time").isNotNull())
         .groupBy("origin_airport_id", "dest_airport_id")
         .agg(F.avg("air_time").alias("avg_air_time"))
         .select(route_label("origin_airport_id", "dest_airport_id").alias("route"), "avg_air_time"))
    return top_k(g, "avg_air_time", ["route"], n)


def flights_by_date(flights: DataFrame) -> DataFrame:
    """Flights per day, ascending date -> (fl_date, n_flights)."""
    return _count_by(flights, F.col("fl_date"), "fl_date", "n_flights").orderBy("fl_date")


def delay_by_hour(flights: DataFrame) -> DataFrame:
    """Mean arrival delay by scheduled departure hour -> (hour, avg_delay)."""
    return _mean_by(flights, hour_of_day("crs_dep_time"), "hour", "arr_delay", "avg_delay").orderBy("hour")


def delay_by_airline(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """Mean arrival delay by carrier, top n -> (op_carrier, avg_arr_delay)."""
    g = _mean_by(flights, F.col("op_carrier"), "op_carrier", "arr_delay", "avg_arr_delay")
    return top_k(g, "avg_arr_delay", ["op_carrier"], n)


def distance_airtime_pairs(flights: DataFrame) -> DataFrame:
    """A9 (points): every non-null (distance, air_time) pair."""
    return flights.select("flight_id", "distance", "air_time").dropna(subset=["distance", "air_time"])


def distance_airtime_points(flights: DataFrame) -> DataFrame:
    """A9 (points, for display): distinct (distance, air_time) points with their
    row count. Nothing is dropped: every pair is one of the points, weighted by
    n. The size is bounded by the distinct pairs, not by the rows."""
    return (flights.select("distance", "air_time").dropna()
            .groupBy("distance", "air_time").agg(F.count(F.lit(1)).alias("n")))


def cancellation_rate(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """A10: cancellation % per carrier, top n. Carriers with no cancellation are
    absent (the reference divides aligned series and drops the NaN)."""
    g = (flights.where(F.col("op_carrier").isNotNull())
         .groupBy("op_carrier")
         .agg(F.count_if(F.col("cancelled")).alias("_c"), F.count(F.lit(1)).alias("_n"))
         .where(F.col("_c") > 0)
         .select("op_carrier", (F.lit(100.0) * F.col("_c") / F.col("_n")).alias("cancel_rate_pct")))
    return top_k(g, "cancel_rate_pct", ["op_carrier"], n)


def most_common_routes(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """Most common routes, top n -> (route, n_flights)."""
    g = (_route_groups(flights).groupBy("origin_airport_id", "dest_airport_id")
         .agg(F.count(F.lit(1)).alias("n_flights"))
         .select(route_label("origin_airport_id", "dest_airport_id").alias("route"), "n_flights"))
    return top_k(g, "n_flights", ["route"], n)


def iso_weekday(date_col: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return ((F.dayofweek(date_col) + 5) % 7 + 1).cast("int")


def delay_by_weekday(flights: DataFrame) -> DataFrame:
    """Mean arrival delay by weekday, Monday..Sunday; missing days absent."""
    g = _mean_by(flights.where(F.col("arr_delay").isNotNull()), iso_weekday(F.col("fl_date")),
                 "weekday_no", "arr_delay", "avg_delay")
    names = F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_NAMES]), F.col("weekday_no"))
    return g.select("weekday_no", names.alias("weekday"), "avg_delay").orderBy("weekday_no")


def delay_by_state(flights: DataFrame, airports: DataFrame, n: int = TOP_N, fanout: bool = False,
                   max_dim_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Mean arrival delay by origin state (via J1), top n -> (state_name, mean_delay)."""
    j = flights_with_airports(flights.select("origin_airport_id", "arr_delay"), airports,
                              fanout=fanout, max_dim_rows=max_dim_rows)
    g = _mean_by(j, F.col("origin_state_name"), "state_name", "arr_delay", "mean_delay")
    return top_k(g, "mean_delay", ["state_name"], n)


def most_diverted_airports(flights: DataFrame, n: int = TOP_N) -> DataFrame:
    """Diverted flights per destination airport, top n."""
    g = _count_by(flights.where(F.col("diverted")), F.col("dest_airport_id").cast("string"),
                  "dest_airport_id", "diverted_count")
    return top_k(g, "diverted_count", ["dest_airport_id"], n)


def monthly_delay_trend(flights: DataFrame) -> DataFrame:
    """Mean arrival delay by calendar month, years pooled, January..December."""
    g = _mean_by(flights.where(F.col("arr_delay").isNotNull()), F.month("fl_date"),
                 "month_no", "arr_delay", "avg_delay")
    names = F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), F.col("month_no"))
    return g.select("month_no", names.alias("month"), "avg_delay").orderBy("month_no")


def _top_count_keep_null(flights: DataFrame, key: str, n: int) -> DataFrame:
    g = flights.groupBy(key).agg(F.count(F.lit(1)).alias("n_flights"))
    return top_k(g, "n_flights", [key], n)


def top_planes(flights: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent flight numbers (null group kept) -> (op_carrier_fl_num, n_flights)."""
    return _top_count_keep_null(flights, "op_carrier_fl_num", n)


def top_airlines(flights: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent carriers (null group kept) -> (op_carrier, n_flights)."""
    return _top_count_keep_null(flights, "op_carrier", n)
