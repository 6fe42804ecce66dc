"""Charts kept up to date by day.

``add`` reduces the rows of a load to partial sums per day and chart key, and stores them beside
those of earlier loads (``sources.versioned``, one part per month): a load costs what it brings, not what is
stored. ``replace`` recomputes whole months from the fact table where rows were changed or removed. The
charts of any date window are merged from the days' sums; only the window's months are read.

Every version carries the state of the data it stands for (``version``: a load id, a table
version). ``charts`` is asked for a state and refuses with ``StaleCharts`` when the store stands for another one, so
no answer is older than the data. A load that is added again under the state the store has already is left out.

Rows without a date lie in no window and are not stored. Requests with a route, plane, airline or
airport filter need the rows themselves (``dashboard``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airmetrics.functions.clean import hour_of_day
from airmetrics.operators import filters as flt
from airmetrics.operators.histogram import histogram
from airmetrics.plans import dashboard as dash
from airmetrics.session import cut_lineage
from airmetrics.sources import versioned

# the sets of the dashboard's summary, and the values behind the histogram and the scatter
VALUE_KEYS = ["v_delay", "v_distance", "v_air_time"]
SETS = dash.SUMMARY_SETS | {"delay": ["v_delay"], "point": ["v_distance", "v_air_time"]}
KEYS = ["day", *dash.SUMMARY_KEYS, *VALUE_KEYS]
MEASURES = ["n", "n_cancel", "n_divert", "s_arr", "c_arr", "s_air", "c_air"]


class StaleCharts(RuntimeError):
    """The stored charts stand for another state of the data than the one asked for."""


def day_sums(flights: DataFrame) -> DataFrame:
    """Partial sums per day and key of every set: one scan, one shuffle of rows summed map-side."""
    f = flights.where(F.col("fl_date").isNotNull()).select(
        *[c for c in dash.CHART_COLUMNS if c != "flight_id"], hour_of_day("crs_dep_time").alias("hour"), F.col("fl_date").alias("day"),
        F.col("arr_delay").alias("v_delay"), F.col("distance").alias("v_distance"), F.col("air_time").alias("v_air_time"))
    gid = {name: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in ("day", *keys)) for name, keys in SETS.items()}
    name = F.element_at(F.create_map(*[F.lit(x) for n, g in gid.items() for x in (g, n)]), F.col("gid").cast("int"))
    g = f.groupingSets([["day", *keys] for keys in SETS.values()], *KEYS).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("cancelled")).alias("n_cancel"),
        F.count_if(F.col("diverted")).alias("n_divert"), F.sum("arr_delay").alias("s_arr"), F.count("arr_delay").alias("c_arr"),
        F.sum("air_time").alias("s_air"), F.count("air_time").alias("c_air"))
    month = F.date_format("day", "yyyy-MM")
    return g.select(name.alias("set"), *KEYS, *MEASURES, month.alias("part")).sortWithinPartitions("part", "set", "day")


def add(flights: DataFrame, path: str, version: str) -> bool:
    """Add the rows of a load; False when the store has this state already (a load taken twice)."""
    spark = flights.sparkSession
    if versioned.token(spark, path) == version:
        return False
    versioned.write(day_sums(flights), path, "add", version)
    return True


def replace(flights: DataFrame, path: str, version: str, months: list[str]) -> None:
    """Recompute ``months`` ('yyyy-MM') from the fact table, of which only those months are read."""
    rows = flights.where(F.col("fl_month").isin(months)) if "fl_month" in flights.columns else flights.where(
        F.date_format("fl_date", "yyyy-MM").isin(months))
    versioned.write(day_sums(rows), path, "replace", version, months)


def compact(spark: SparkSession, path: str, columns: StructType) -> None:
    """Merge the versions of every month that has several into one; the state of the data stays."""
    parts = [p for _, p in versioned.live(spark, path)]
    many = sorted({p for p in parts if parts.count(p) > 1})
    if many:
        rows = versioned.read(spark, path, columns, many)
        versioned.write(_merged(rows, ["set", *KEYS, "part"]), path, "replace", versioned.token(spark, path), many)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def schema(flights: DataFrame) -> StructType:
    return day_sums(flights.limit(0)).schema


def bounds(spark: SparkSession, path: str, columns: StructType):
    """First and last day stored, from the outermost two months alone."""
    months = sorted({p for _, p in versioned.live(spark, path)})
    if not months:
        return None, None
    days = versioned.read(spark, path, columns, {months[0], months[-1]}).where(F.col("set") == "date")
    return tuple(days.agg(F.min("day"), F.max("day")).first())


def window_rows(spark: SparkSession, path: str, columns: StructType, start=None, end=None) -> DataFrame:
    """The day sums of a window (F7 rules); only its months are read."""
    win = flt.resolve_window(start, end, *bounds(spark, path, columns))
    months = [p for _, p in versioned.live(spark, path)
              if (win.start is None or p >= f"{win.start:%Y-%m}") and (win.end is None or p <= f"{win.end:%Y-%m}")]
    rows = versioned.read(spark, path, columns, months)
    return rows if win.start is None else rows.where(F.col("day").between(F.lit(win.start), F.lit(win.end)))


def charts(spark: SparkSession, path: str, airports: DataFrame, columns: StructType, version: str, start=None, end=None) -> dict[str, DataFrame]:
    """The charts of a window, and the facets, from the stored days.

    ``version``: the state of the data that the answer must stand for. ``columns``: ``schema`` of the fact table.
    """
    have = versioned.token(spark, path)
    if have != version:
        raise StaleCharts(f"stored charts stand for {have!r}, asked for {version!r}")
    rows = window_rows(spark, path, columns, start, end)
    gid = F.create_map(*[x for n, keys in dash.SUMMARY_SETS.items() for x in (F.lit(n), F.lit(dash._gid(keys)))])
    # merged once; a dozen charts read it
    summary = cut_lineage(_merged(rows.where(F.col("set").isin(list(dash.SUMMARY_SETS))), ["set", *dash.SUMMARY_KEYS])
                          .withColumn("gid", F.element_at(gid, F.col("set"))))
    out = dash.charts_from_summary(summary, airports)
    out["arrival_delay_histogram"] = histogram(rows.where((F.col("set") == "delay") & F.col("v_delay").isNotNull()), "v_delay", 50, "n")
    out["distance_airtime_points"] = (
        rows.where((F.col("set") == "point") & F.col("v_distance").isNotNull() & F.col("v_air_time").isNotNull())
        .groupBy(F.col("v_distance").alias("distance"), F.col("v_air_time").alias("air_time")).agg(F.sum("n").alias("n")))
    out["facets"] = dash.facets_from_summary(summary)
    return out
