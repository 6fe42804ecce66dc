"""The dashboard job: date window -> filters -> 14 chart frames (+ facets).

One windowed, column-pruned frame feeds every chart. With ``cache=True`` it is
persisted (memory, spilling to disk) so the charts read it once; on a cluster
with a month-partitioned fact table the window prunes folders and each chart
reads only its columns, so ``cache=False`` is also reasonable.
``materialize_dashboard`` is the batch form of the reference's chart cache (S11).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window

from pyspark.sql import functions as F

from airmetrics.functions.clean import hour_of_day, route_label
from airmetrics.operators import charts as ch
from airmetrics.operators import filters as flt
from airmetrics.operators.histogram import histogram
from airmetrics.operators.joins import bounded_broadcast, dedup_airports

# Columns any chart reads; the windowed frame keeps only these.
CHART_COLUMNS = ["flight_id", "fl_date", "op_carrier", "op_carrier_fl_num", "origin_airport_id",
                 "dest_airport_id", "crs_dep_time", "arr_delay", "cancelled", "diverted",
                 "air_time", "distance"]


def chart_functions(airports: DataFrame, lowess_fn=None) -> dict:
    """The 14 charts of the dashboard, in display order (A1 is defined but off)."""
    fns = {
        "flight_counts": ch.flight_counts,
        "arrival_delay_histogram": lambda d: histogram(d, "arr_delay", 50),
        "cancelled_flights": ch.cancelled_flights,
        "airtime_by_route": ch.airtime_by_route,
        "flights_by_date": ch.flights_by_date,
        "delay_by_hour": ch.delay_by_hour,
        "delay_by_airline": ch.delay_by_airline,
        # the scatter as weighted distinct points: bounded by distinct pairs, not rows
        "distance_airtime_points": ch.distance_airtime_points,
        "cancellation_rate": ch.cancellation_rate,
        "most_common_routes": ch.most_common_routes,
        "delay_by_weekday": ch.delay_by_weekday,
        "delay_by_state": lambda d: ch.delay_by_state(d, airports),
        "most_diverted_airports": ch.most_diverted_airports,
        "monthly_delay_trend": ch.monthly_delay_trend,
    }
    if lowess_fn is not None:
        fns["distance_airtime_lowess"] = lowess_fn
    return fns


def chart_names(with_lowess: bool = True) -> list[str]:
    """Names of the dashboard charts (the keys of ``chart_functions``)."""
    return list(chart_functions(None, (lambda d: d) if with_lowess else None))


# --------------------------------------------------------------------------- single-pass summary

SUMMARY_KEYS = ["op_carrier", "origin_airport_id", "dest_airport_id", "fl_date", "hour", "op_carrier_fl_num"]
SUMMARY_SETS = {
    "carrier": ["op_carrier"],
    "route": ["origin_airport_id", "dest_airport_id"],
    "date": ["fl_date"],
    "hour": ["hour"],
    "origin": ["origin_airport_id"],
    "dest": ["dest_airport_id"],
    "plane": ["op_carrier_fl_num"],
}


def _gid(keys: list[str]) -> int:
    """grouping_id() of a set: one bit per summary key, set when the key is not grouped."""
    n = len(SUMMARY_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(SUMMARY_KEYS) if k not in keys)


def chart_summary(frame: DataFrame) -> DataFrame:
    """One aggregation over the windowed frame for every keyed chart and facet.

    GROUPING SETS expand each row once per set and the partial aggregation
    folds them map-side, so the frame is scanned once and shuffled once; the
    result has one row per carrier, route, day, hour, airport and flight number.
    """
    f = frame.withColumn("hour", hour_of_day("crs_dep_time"))
    return (f.groupingSets([SUMMARY_SETS[k] for k in SUMMARY_SETS], *SUMMARY_KEYS)
            .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("cancelled")).alias("n_cancel"), F.count_if(F.col("diverted")).alias("n_divert"),
                 F.sum("arr_delay").alias("s_arr"), F.count("arr_delay").alias("c_arr"),
                 F.sum("air_time").alias("s_air"), F.count("air_time").alias("c_air")))


def _part(summary: DataFrame, name: str) -> DataFrame:
    keys = SUMMARY_SETS[name]
    cond = F.col("gid") == _gid(keys)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return summary.where(cond)


def charts_from_summary(summary: DataFrame, airports: DataFrame, n: int = ch.TOP_N) -> dict[str, DataFrame]:
    """The keyed charts (A1, A2, A4-A8, A10-A15), equal to the per-chart functions."""
    carrier, route, date = _part(summary, "carrier"), _part(summary, "route"), _part(summary, "date")
    origin, dest, hour = _part(summary, "origin"), _part(summary, "dest"), _part(summary, "hour")
    mean = F.col("s_arr") / F.col("c_arr")
    out = {}
    top = carrier.select("op_carrier", F.col("n").alias("flights"))
    top = ch.top_k(top, "flights", ["op_carrier"], n)
    out["flight_counts"] = top.withColumn("share", F.col("flights") / F.sum("flights").over(Window.partitionBy()))
    out["cancelled_flights"] = ch.top_k(carrier.where(F.col("n_cancel") > 0).select(
        "op_carrier", F.col("n_cancel").alias("cancelled_count")), "cancelled_count", ["op_carrier"], n)
    out["delay_by_airline"] = ch.top_k(carrier.where(F.col("c_arr") > 0).select(
        "op_carrier", mean.alias("avg_arr_delay")), "avg_arr_delay", ["op_carrier"], n)
    out["cancellation_rate"] = ch.top_k(carrier.where(F.col("n_cancel") > 0).select(
        "op_carrier", (F.lit(100.0) * F.col("n_cancel") / F.col("n")).alias("cancel_rate_pct")),
        "cancel_rate_pct", ["op_carrier"], n)
    label = route_label("origin_airport_id", "dest_airport_id").alias("route")
    out["airtime_by_route"] = ch.top_k(route.where(F.col("c_air") > 0).select(
        label, (F.col("s_air") / F.col("c_air")).alias("avg_air_time")), "avg_air_time", ["route"], n)
    out["most_common_routes"] = ch.top_k(route.select(label, F.col("n").alias("n_flights")), "n_flights", ["route"], n)
    out["flights_by_date"] = date.select("fl_date", F.col("n").alias("n_flights")).orderBy("fl_date")
    out["delay_by_hour"] = hour.where(F.col("c_arr") > 0).select("hour", mean.alias("avg_delay")).orderBy("hour")
    dated = date.where(F.col("c_arr") > 0)
    wk = dated.groupBy(ch.iso_weekday(F.col("fl_date")).alias("weekday_no")).agg(
        (F.sum("s_arr") / F.sum("c_arr")).alias("avg_delay"))
    out["delay_by_weekday"] = wk.select("weekday_no", F.element_at(F.array(*[F.lit(x) for x in ch.WEEKDAY_NAMES]),
                                                                   F.col("weekday_no")).alias("weekday"),
                                        "avg_delay").orderBy("weekday_no")
    mo = dated.groupBy(F.month("fl_date").alias("month_no")).agg((F.sum("s_arr") / F.sum("c_arr")).alias("avg_delay"))
    out["monthly_delay_trend"] = mo.select("month_no", F.element_at(F.array(*[F.lit(x) for x in ch.MONTH_NAMES]),
                                                                    F.col("month_no")).alias("month"),
                                           "avg_delay").orderBy("month_no")
    out["most_diverted_airports"] = ch.top_k(dest.where(F.col("n_divert") > 0).select(
        F.col("dest_airport_id").cast("string").alias("dest_airport_id"), F.col("n_divert").alias("diverted_count")),
        "diverted_count", ["dest_airport_id"], n)
    out["delay_by_airport"] = ch.top_k(origin.where(F.col("c_arr") > 0).select(
        F.col("origin_airport_id").cast("string").alias("origin_airport_id"), mean.alias("arr_delay")),
        "arr_delay", ["origin_airport_id"], n)
    dim = dedup_airports(airports).select(F.col("airport_id").alias("origin_airport_id"), "state_name")
    st = (origin.join(bounded_broadcast(dim), "origin_airport_id").where(F.col("state_name").isNotNull())
          .groupBy("state_name").agg(F.sum("s_arr").alias("s"), F.sum("c_arr").alias("c"))
          .where(F.col("c") > 0).select("state_name", (F.col("s") / F.col("c")).alias("mean_delay")))
    out["delay_by_state"] = ch.top_k(st, "mean_delay", ["state_name"], n)
    return out


def facets_from_summary(summary: DataFrame) -> DataFrame:
    """F9 facets (route, plane, airline, airport) from the same summary."""
    route = _part(summary, "route").select(F.lit("route").alias("facet"),
                                           route_label("origin_airport_id", "dest_airport_id").alias("value"))
    plane = _part(summary, "plane").select(F.lit("plane").alias("facet"), F.col("op_carrier_fl_num").alias("value"))
    airline = _part(summary, "carrier").select(F.lit("airline").alias("facet"), F.col("op_carrier").alias("value"))
    ports = (_part(summary, "origin").select(F.col("origin_airport_id").alias("a"))
             .union(_part(summary, "dest").select(F.col("dest_airport_id").alias("a"))).distinct()
             .select(F.lit("airport").alias("facet"), F.col("a").cast("string").alias("value")))
    return route.unionByName(plane).unionByName(airline).unionByName(ports)


@dataclass
class Dashboard:
    """Chart frames are built on demand: some builders run small actions of
    their own (histogram bounds, LOWESS steps), and ``collect`` runs those
    inside its worker threads too."""
    window: flt.Window
    no_data: bool
    frame: DataFrame
    builders: dict = field(default_factory=dict)
    facets: DataFrame | None = None
    summary: DataFrame | None = None

    @property
    def charts(self) -> dict[str, DataFrame]:
        return {name: build() for name, build in self.builders.items()}

    def collect(self, parallel: int = 8) -> dict[str, list]:
        """Run every chart (and the facets) as concurrent Spark jobs and return
        their small results. The jobs are independent, so submitting them from a
        few driver threads overlaps their scheduling latency; the work itself
        stays in the executors."""
        from concurrent.futures import ThreadPoolExecutor

        jobs = {name: (lambda b=build: b().collect()) for name, build in self.builders.items()}
        if self.facets is not None:
            jobs["facets"] = self.facets.collect
        # the slowest builders first, so they start while the small ones run
        order = sorted(jobs, key=lambda n: n not in ("distance_airtime_lowess", "arrival_delay_histogram"))
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            futures = {name: pool.submit(jobs[name]) for name in order}
            return {name: f.result() for name, f in futures.items()}

    def release(self) -> None:
        self.frame.unpersist()
        if self.summary is not None:
            self.summary.unpersist()


def dashboard(flights: DataFrame, airports: DataFrame, start=None, end=None, route=None, plane=None,
              airlines=None, airport=None, cache: bool = True, with_lowess: bool = True,
              single_pass: bool = True) -> Dashboard:
    """Resolve the window (F7), filter (F1-F6), and build every chart frame.

    ``single_pass``: the keyed charts and the facets come from one grouping-sets
    aggregation (``chart_summary``); the histogram, the scatter pairs and the
    LOWESS curve read the frame themselves.
    """
    win = flt.window_from_bounds(flights, start, end)
    cols = [c for c in CHART_COLUMNS + ["fl_month"] if c in flights.columns]
    window_frame = flt.between_dates(flights.select(*cols), win.start, win.end)
    frame = flt.select_flights(window_frame, None, None, route, plane, airlines, airport)
    if cache:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    if frame.isEmpty():  # F8
        return Dashboard(win, True, frame, {}, flt.facets(window_frame))
    bind = lambda fn: (lambda: fn(frame))
    lowess_fn = None
    if with_lowess:
        from airmetrics.operators.lowess import lowess
        lowess_fn = lambda d: lowess(d, "distance", "air_time")
    fns = chart_functions(airports, lowess_fn)
    if not single_pass:
        return Dashboard(win, False, frame, {name: bind(fn) for name, fn in fns.items()}, flt.facets(frame))
    summary = chart_summary(frame)
    if cache:  # many small charts read it; without cache each recomputes it
        summary = summary.persist(StorageLevel.MEMORY_AND_DISK)
    keyed = charts_from_summary(summary, airports)
    builders = {name: ((lambda df=keyed[name]: df) if name in keyed else bind(fn)) for name, fn in fns.items()}
    return Dashboard(win, False, frame, builders, facets_from_summary(summary), summary)


def params_key(**params) -> str:
    """Stable key of the dashboard parameters (folder name of a stored chart)."""
    text = json.dumps({k: (sorted(v) if isinstance(v, (list, tuple, set)) else v)
                       for k, v in sorted(params.items())}, default=str, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def materialize_dashboard(flights: DataFrame, airports: DataFrame, base: str, **params) -> dict[str, str]:
    """Compute every chart once for ``params`` and store it under
    ``base/charts/<name>/params=<key>`` (overwrite: a re-run replaces it)."""
    d = dashboard(flights, airports, **params)
    key = params_key(**params)
    paths = {}
    try:
        for name, build in d.builders.items():
            path = f"{base.rstrip('/')}/charts/{name}/params={key}"
            build().write.mode("overwrite").parquet(path)
            paths[name] = path
    finally:
        d.release()
    return paths


def read_materialized(spark, base: str, names: list[str] | None = None, parallel: int = 8,
                      **params) -> dict[str, list] | None:
    """Serve a dashboard request from charts stored by ``materialize_dashboard``
    (the batch side of the reference's chart cache). None when a chart for these
    parameters is missing, in which case the caller computes the dashboard."""
    from concurrent.futures import ThreadPoolExecutor

    key = params_key(**params)
    names = names or chart_names()
    paths = {n: f"{base.rstrip('/')}/charts/{n}/params={key}" for n in names}
    try:
        frames = {n: spark.read.parquet(p) for n, p in paths.items()}
    except Exception:  # noqa: BLE001 - a missing folder means "not materialized"
        return None
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = {n: pool.submit(df.collect) for n, df in frames.items()}
        return {n: f.result() for n, f in futures.items()}
