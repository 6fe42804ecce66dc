"""Cleaning and star-schema modelling.

Each function is one projection or one aggregation over the input; no row loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics import schemas
from airmetrics.functions.clean import (date_text, hhmm_truncated, parse_date_text, seconds_from_hhmm,
                                        to_bool, to_number)

KEY_COLUMNS = ["FLIGHT_ID", "TAIL_NUM"]


def prune_columns(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Keep the canonical columns (and the record key / tail number if present)."""
    keep = keep or schemas.CANONICAL_COLUMNS
    lookup = {c.upper(): c for c in raw.columns}
    extras = [lookup[k] for k in KEY_COLUMNS if k in lookup]
    return raw.select(*extras, *[lookup.get(c.upper(), c) for c in keep if c not in KEY_COLUMNS])


def canonical_names(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename source names to canonical names; fail if a canonical name is missing."""
    mapping = mapping or schemas.SOURCE_TO_CANONICAL
    renamed = raw.withColumnsRenamed({k: v for k, v in mapping.items() if k in raw.columns})
    have = {c.upper() for c in renamed.columns}
    missing = [c for c in schemas.CANONICAL_COLUMNS if c not in have]
    if missing:
        raise ValueError(f"missing canonical columns: {missing}")
    return renamed


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case all column names."""
    return df.toDF(*[c.lower() for c in df.columns])


def canonical_columns(raw: DataFrame) -> DataFrame:
    """C1 + C2 + C3 in one projection."""
    return lower_names(prune_columns(canonical_names(raw)))


def with_flight_id(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Deterministic surrogate key.

    A record that carries a packed natural key (``flight_id``) keeps it. Otherwise
    the key is a 64-bit hash of the natural key columns: stable under any
    partitioning and recomputation, unlike ``monotonically_increasing_id``, and
    with no global ``row_number`` (which would run in one task).
    """
    if "flight_id" in df.columns:
        return df.withColumn("flight_id", F.col("flight_id").cast("long"))
    key_cols = key_cols or ["fl_date", "op_unique_carrier", "op_carrier_fl_num",
                            "origin_airport_id", "dest_airport_id", "crs_dep_time"]
    return df.withColumn("flight_id", F.xxhash64(*key_cols))


def build_flights(raw: DataFrame) -> DataFrame:
    """C11: raw record -> fact row. C5-C8 applied as native expressions.

    Two projections: the first computes the shared pieces (trimmed date text,
    truncated HHMM values), the second the final columns from them. Catalyst
    keeps the two apart because the pieces are referenced many times, so each
    is computed once and the generated code stays small enough to be compiled.
    """
    df = with_flight_id(canonical_columns(raw))
    has_tail = "tail_num" in df.columns
    staged = df.select(
        "flight_id", "op_unique_carrier", "op_carrier_airline_id", "op_carrier", "op_carrier_fl_num",
        "origin_airport_id", "dest_airport_id",
        (F.col("tail_num") if has_tail else F.lit(None)).cast("string").alias("tail_num"),
        date_text("fl_date").alias("_fl_date_text"),
        *[hhmm_truncated(c).alias(f"_hhmm_{c}") for c in schemas.CLOCK_COLUMNS],
        *[F.col(c) for c in schemas.NUMERIC_COLUMNS + schemas.FLAG_COLUMNS])
    exprs: dict[str, Column] = {
        "flight_id": F.col("flight_id"),
        "fl_date": parse_date_text("_fl_date_text"),
        "op_unique_carrier": F.col("op_unique_carrier").cast("string"),
        "op_carrier_airline_id": F.col("op_carrier_airline_id").try_cast("int"),
        "op_carrier": F.col("op_carrier").cast("string"),
        "tail_num": F.col("tail_num"),
        "op_carrier_fl_num": F.col("op_carrier_fl_num").cast("string"),
        "origin_airport_id": F.col("origin_airport_id").try_cast("int"),
        "dest_airport_id": F.col("dest_airport_id").try_cast("int"),
    }
    for c in schemas.CLOCK_COLUMNS:
        exprs[c] = seconds_from_hhmm(f"_hhmm_{c}")
    for c in schemas.NUMERIC_COLUMNS:
        exprs[c] = to_number(c)
    for c in schemas.FLAG_COLUMNS:
        exprs[c] = to_bool(c)
    return staged.select(*[exprs[c].alias(c) for c in schemas.FLIGHT_COLUMNS])


def build_airlines(flights: DataFrame) -> DataFrame:
    """One row per airline id; the smallest carrier code wins (no row order
    exists in a distributed table, so 'first seen' becomes 'min')."""
    return (flights.select(F.col("op_carrier_airline_id").alias("airline_id"),
                           F.col("op_unique_carrier").alias("unique_carrier"))
            .where(F.col("airline_id").isNotNull())
            .groupBy("airline_id").agg(F.min("unique_carrier").alias("unique_carrier")))


_AIRPORT_ATTRS = ["city_market_id", "code", "city_name", "state_abr", "state_fips", "state_name", "wac"]
_AIRPORT_SOURCE = {"city_market_id": "city_market_id", "code": "", "city_name": "city_name",
                   "state_abr": "state_abr", "state_fips": "state_fips", "state_name": "state_nm", "wac": "wac"}


def build_airports(canonical: DataFrame) -> DataFrame:
    """Origin columns union destination columns, one row per (id, seq).

    Input: the canonical (lower-case) wide record. Attributes of duplicated keys
    are resolved by min over the attribute tuple (deterministic).
    """
    def side(prefix: str) -> DataFrame:
        cols = [F.col(f"{prefix}_airport_id").try_cast("int").alias("airport_id"),
                F.col(f"{prefix}_airport_seq_id").try_cast("int").alias("airport_seq_id")]
        for a in _AIRPORT_ATTRS:
            src = prefix if a == "code" else f"{prefix}_{_AIRPORT_SOURCE[a]}"
            typ = "int" if a == "wac" else "string"
            cols.append(F.col(src).try_cast(typ).alias(a))
        return canonical.select(*cols)

    both = side("origin").unionByName(side("dest")).where(F.col("airport_id").isNotNull())
    return (both.groupBy("airport_id", "airport_seq_id")
            .agg(F.min(F.struct(*_AIRPORT_ATTRS)).alias("a"))
            .select("airport_id", "airport_seq_id", *[F.col(f"a.{c}").alias(c) for c in _AIRPORT_ATTRS]))


def normalize_for_export(df: DataFrame) -> DataFrame:
    """One projection making a frame safe for a text/JSON sink.

    NaN -> null for floating columns, dates/timestamps -> ISO text, booleans kept,
    integers kept (nullable), anything else -> text.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            e = F.when(~F.isnan(c), c)
        elif isinstance(t, T.DateType):
            e = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            e = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(t, (T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                            T.DecimalType, T.StringType)):
            e = c
        else:
            e = c.cast("string")
        out.append(e.alias(f.name))
    return df.select(*out)
