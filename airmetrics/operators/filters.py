"""Filters, window rules, facets and paging.

Predicates are plain column expressions, so Catalyst pushes them into the
parquet scan (and prunes month partitions when the flights table is stored
partitioned by month, see sources.tables).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.functions.clean import route_label, seconds_to_hhmmss
from airmetrics.operators import paging
from airmetrics.schemas import CLOCK_COLUMNS


def _as_date(v) -> dt.date | None:
    if v is None or v == "":
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    try:
        return dt.datetime.strptime(str(v), "%Y-%m-%d").date()
    except ValueError:
        return None


def between_dates(df: DataFrame, start, end, col: str = "fl_date") -> DataFrame:
    """inclusive on both ends; applied only when both ends are given."""
    s, e = _as_date(start), _as_date(end)
    if s is None or e is None:
        return df
    pred = F.col(col).between(F.lit(s), F.lit(e))
    if "fl_month" in df.columns:  # partition column of the stored table: prune files
        pred = pred & F.col("fl_month").between(F.lit(s.strftime("%Y-%m")), F.lit(e.strftime("%Y-%m")))
    return df.where(pred)


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """list -> IN, scalar -> equality; falsy values and unknown columns skipped."""
    preds: list[Column] = []
    for name, val in (filters or {}).items():
        if not val or name not in df.columns:
            continue
        preds.append(F.col(name).isin(list(val)) if isinstance(val, (list, tuple, set)) else F.col(name) == F.lit(val))
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def filter_airlines(df: DataFrame, carriers: list[str] | None) -> DataFrame:
    """carrier IN (...)."""
    return df.where(F.col("op_carrier").isin(list(carriers))) if carriers else df


def filter_plane(df: DataFrame, plane: str | None) -> DataFrame:
    """flight number equals."""
    return df.where(F.col("op_carrier_fl_num") == F.lit(str(plane))) if plane else df


def with_route(df: DataFrame) -> DataFrame:
    """F5 (label): add ``route`` = 'origin → dest'."""
    return df.withColumn("route", route_label("origin_airport_id", "dest_airport_id"))


def filter_route(df: DataFrame, route: str | None) -> DataFrame:
    """route equals. The label is split back into two integer predicates so
    they reach the scan; the label test itself stays for exactness."""
    if not route:
        return df
    parts = [p.strip() for p in route.split("→")]
    preds = route_label("origin_airport_id", "dest_airport_id") == F.lit(route)
    if len(parts) == 2 and all(p.lstrip("-").isdigit() for p in parts):
        preds = (F.col("origin_airport_id") == int(parts[0])) & (F.col("dest_airport_id") == int(parts[1])) & preds
    return df.where(preds)


def filter_airport(df: DataFrame, airport) -> DataFrame:
    """airport is origin or destination (parameter read as an integer id)."""
    if airport in (None, ""):
        return df
    try:
        a = int(airport)
    except (TypeError, ValueError):
        return df.where(F.lit(False))
    return df.where((F.col("origin_airport_id") == a) | (F.col("dest_airport_id") == a))


@dataclass(frozen=True)
class Window:
    start: dt.date | None
    end: dt.date | None
    warning: str | None


def resolve_window(start, end, lo, hi, default_days: int = 365) -> Window:
    """date window rules of the dashboard.

    1. an end later than the last date is clamped to it (with a warning);
    2. if both are given and start > end they are swapped;
    3. a missing start defaults to last date - 365 days, a missing end to the last date.
    An unparseable end is treated as not given. Defaults never trigger a swap.
    """
    hi_d, lo_d = _as_date(hi), _as_date(lo)
    s, e = _as_date(start), _as_date(end)
    warning = None
    if e is not None and hi_d is not None and e > hi_d:
        e = hi_d
        warning = f"end date clamped to the last available day: {hi_d.isoformat()}"
    if s is not None and e is not None and s > e:
        s, e = e, s
    if s is None and hi_d is not None:  # an empty table has no last date: the window stays open (no_data)
        s = hi_d - dt.timedelta(days=default_days)
    if e is None:
        e = hi_d
    return Window(s, e, warning)


def window_from_bounds(df: DataFrame, start=None, end=None, col: str = "fl_date") -> Window:
    """F7 with the bounds read from the table (one aggregate row to the driver)."""
    b = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return resolve_window(start, end, b["lo"], b["hi"])


def select_flights(df: DataFrame, start=None, end=None, route=None, plane=None,
                   airlines=None, airport=None) -> DataFrame:
    """F1+F3-F6 in the dashboard's order (the window must already be resolved)."""
    out = between_dates(df, start, end)
    out = filter_airlines(out, airlines)
    out = filter_plane(out, plane)
    out = filter_route(out, route)
    return filter_airport(out, airport)


# ----------------------------------------------------------------------------- facets

def facet_routes(df: DataFrame) -> DataFrame:
    return (df.where(F.col("origin_airport_id").isNotNull() & F.col("dest_airport_id").isNotNull())
            .select("origin_airport_id", "dest_airport_id").distinct()
            .select(route_label("origin_airport_id", "dest_airport_id").alias("route")))


def facet_planes(df: DataFrame) -> DataFrame:
    return df.select("op_carrier_fl_num").where(F.col("op_carrier_fl_num").isNotNull()).distinct()


def facet_airlines(df: DataFrame) -> DataFrame:
    return df.select("op_carrier").where(F.col("op_carrier").isNotNull()).distinct()


def facet_airports(df: DataFrame) -> DataFrame:
    """Origin ids union destination ids, distinct, sorted."""
    o = df.select(F.col("origin_airport_id").alias("airport_id"))
    d = df.select(F.col("dest_airport_id").alias("airport_id"))
    return o.union(d).where(F.col("airport_id").isNotNull()).distinct().orderBy("airport_id")


def facets(df: DataFrame) -> DataFrame:
    """All four facets as one (facet, value) frame."""
    return (facet_routes(df).select(F.lit("route").alias("facet"), F.col("route").alias("value"))
            .unionByName(facet_planes(df).select(F.lit("plane").alias("facet"), F.col("op_carrier_fl_num").alias("value")))
            .unionByName(facet_airlines(df).select(F.lit("airline").alias("facet"), F.col("op_carrier").alias("value")))
            .unionByName(facet_airports(df).select(F.lit("airport").alias("facet"),
                                                   F.col("airport_id").cast("string").alias("value"))))


def empty_result_facets(filtered: DataFrame, window_frame: DataFrame) -> tuple[bool, DataFrame]:
    """F8: when the filters leave no row, answer with the facets of the date window
    only and flag ``no_data``; otherwise the facets of the filtered rows."""
    if filtered.isEmpty():
        return True, facets(window_frame)
    return False, facets(filtered)


# ----------------------------------------------------------------------------- paging

def flight_projection(df: DataFrame) -> DataFrame:
    """the 22-column flight row with clock columns as 'HH:mm:ss' text."""
    return df.select(*[seconds_to_hhmmss(c).alias(c) if c in CLOCK_COLUMNS else F.col(c)
                       for c in df.columns if c != "fl_month"])


DEEP_PAGE_ROWS = 10_000  # beyond this offset, pages are cut from the range of keys that holds them


def page(df: DataFrame, key: str | list[str] = "flight_id", page_no: int = 1, size: int = 50) -> DataFrame:
    """page >= 1, 1 <= size <= 1000; rows ordered by the key or keys, ties by the other columns (stable pages).

    Shallow pages are ``orderBy(...).offset(k).limit(n)`` (a per-partition top
    k+n, merged). Deep pages would make that top-k grow with the offset, so past
    ``DEEP_PAGE_ROWS`` rows the range of keys around the page is found first (``paging.page_at``, any
    keys) and only its rows are sorted. Both give the same rows.
    """
    if page_no < 1 or not 1 <= size <= 1000:
        raise ValueError("page must be >= 1 and 1 <= size <= 1000")
    keys = [key] if isinstance(key, str) else list(key)
    off = (page_no - 1) * size
    if off + size > DEEP_PAGE_ROWS:
        return paging.page_at(df, keys, off, size)
    ordered = df.orderBy(*[F.col(f"`{c}`") for c in paging.total_order(df, keys)])
    return (ordered.offset(off) if off else ordered).limit(size)


def page_by_rank(df: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """Rows ranked offset+1 .. offset+size in ``key`` order, without a global top-k."""
    from airmetrics.operators.scan import blocks_for, prefix_scan

    rows = df.count()
    ranked = prefix_scan(df.withColumn("_one", F.lit(1)), key, {"_rank": ("sum", "_one")},
                         blocks=blocks_for(rows))
    return (ranked.where((F.col("_rank") > offset) & (F.col("_rank") <= offset + size))
            .drop("_one", "_rank").orderBy(key))


def page_after(df: DataFrame, key: str | list[str], last_key, size: int = 50) -> DataFrame:
    """F10 keyset form for deep pages: rows whose key (or keys) come after ``last_key`` (a value, or
    one per key), first ``size``. The first key's bound is pushed to the scan; cost does not grow with the page number.
    The keys must be unique: rows that share the last key with the page before are passed over."""
    keys = [key] if isinstance(key, str) else list(key)
    last = None if last_key is None else (last_key,) if isinstance(key, str) else tuple(last_key)
    out = df if last is None else df.where(paging.after(df, keys, last))
    return out.orderBy(*[F.col(f"`{k}`") for k in keys]).limit(size)


def flights_of_airline(df: DataFrame, airline_id: int | None) -> DataFrame:
    """flights of one airline (page with ``page``)."""
    return df if airline_id is None else df.where(F.col("op_carrier_airline_id") == F.lit(int(airline_id)))


def sample_flights(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """the loader's optional fixed sample (off by default: all rows)."""
    if not limit:
        return df
    ordered = df.orderBy("flight_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)
