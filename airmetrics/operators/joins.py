"""Join helpers and the two joins of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest dimension we are willing to ship to every executor.
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan early),
    so it is cheap for a real dimension and bounded for anything else. Above the
    bound the frame is returned unhinted and Spark plans a shuffle join (or AQE
    turns it into a broadcast if runtime statistics allow).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dedup_airports(airports: DataFrame) -> DataFrame:
    """One row per airport_id: the row with the largest airport_seq_id (latest)."""
    rest = [c for c in airports.columns if c != "airport_id"]
    return (airports.groupBy("airport_id")
            .agg(F.max_by(F.struct(*rest), F.col("airport_seq_id")).alias("a"))
            .select("airport_id", *[F.col(f"a.{c}").alias(c) for c in rest]))


def flights_with_airports(flights: DataFrame, airports: DataFrame, fanout: bool = False,
                          max_dim_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Flights inner-join origin airport.

    ``fanout=True`` keeps every (airport_id, airport_seq_id) row, so an airport with
    several sequence rows repeats its flights (the reference's behaviour).
    Default: one row per airport (latest sequence id).
    """
    dim = airports if fanout else dedup_airports(airports)
    dim = dim.select(F.col("airport_id").alias("origin_airport_id"),
                     *[F.col(c).alias(f"origin_{c}") for c in dim.columns if c != "airport_id"])
    return flights.join(bounded_broadcast(dim, max_dim_rows), "origin_airport_id", "inner")


def last_wins(df: DataFrame, key: str | list[str], order: Column | str,
              value_cols: list[str] | None = None) -> DataFrame:
    """Keep, per key, the row with the largest ``order`` (all value columns from it).

    ``max_by`` over a struct is a hash aggregate with map-side partial merge, so a
    hot key does not gather its rows in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    value_cols = value_cols or [c for c in df.columns if c not in keys]
    order_col = F.col(order) if isinstance(order, str) else order
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*value_cols), order_col).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
