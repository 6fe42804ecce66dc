"""Flight-domain tables derived from the driver's TPC-H-style tables.

The mapping is the one documented in FIXTURES.md section 5: every lineitem row
becomes one raw on-time record (dirty text dates, HHMM clocks, blank numbers),
nation x region become the airports dimension, and events become aircraft
state vectors plus a flight list. All of it is plain DataFrame code, so the
derived tables grow with the inputs and are produced by Spark in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.operators.joins import bounded_broadcast

TPCH_NATIONS = 25  # size bound of the nation table (TPC-H fixes it)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _clock_raw(orderkey, base_hhmm):
    """HHMM clock as a raw double, with the four dirty cases keyed by orderkey % 101."""
    k = orderkey % 101
    return (F.when(k == 0, F.lit(2400.0))
             .when(k == 1, F.lit(2475.0))
             .when(k == 2, F.lit(1275.0))
             .when(k == 3, F.lit(None).cast("double"))
             .otherwise(base_hhmm.cast("double")))


def _num_text(x):
    """A number as CSV text; null becomes a blank field."""
    return F.coalesce(x.cast("string"), F.lit(""))


def _nation_place(nation: DataFrame, region: DataFrame, prefix: str) -> DataFrame:
    """Per-nation airport columns, named for the origin or destination side."""
    n = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return n.select(
        F.col("n_nationkey").alias(f"_{prefix}_nk"),
        F.col("n_name").alias(f"{prefix}"),
        (30000 + F.col("n_nationkey")).cast("string").alias(f"{prefix}_CITY_MARKET_ID"),
        F.col("n_name").alias(f"{prefix}_CITY_NAME"),
        F.substring("r_name", 1, 2).alias(f"{prefix}_STATE_ABR"),
        F.col("n_regionkey").cast("string").alias(f"{prefix}_STATE_FIPS"),
        F.col("r_name").alias(f"{prefix}_STATE_NM"),
        F.col("n_regionkey").cast("int").alias(f"{prefix}_WAC"),
    )


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw on-time records with canonical upper-case names plus a few source extras.

    Types are what a permissive CSV read leaves: dates and numbers as text,
    clocks as HHMM doubles, flags as 1.0/0.0 with blanks.
    """
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    origin = bounded_broadcast(_nation_place(nation, region, "ORIGIN"), TPCH_NATIONS)
    dest = bounded_broadcast(_nation_place(nation, region, "DEST"), TPCH_NATIONS)

    # Join order: orders x customer first (orders is a quarter of lineitem), so
    # the wide lineitem stream is shuffled once per remaining key (orderkey,
    # suppkey, partkey) rather than also on custkey. Joins to growing tables
    # are left to the planner (shuffle joins at scale; AQE broadcasts small ones
    # at runtime and splits skewed keys); only nation is hinted (25 rows).
    order_nation = orders.join(customer, F.col("o_custkey") == customer.c_custkey) \
        .select("o_orderkey", "c_nationkey")
    j = (li.join(order_nation, li.l_orderkey == order_nation.o_orderkey)
           .join(supplier, li.l_suppkey == supplier.s_suppkey)
           .join(part, li.l_partkey == part.p_partkey)
           .join(origin, F.col("s_nationkey") == F.col("_ORIGIN_nk"))
           .join(dest, F.col("c_nationkey") == F.col("_DEST_nk")))

    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    brand_no = F.split(F.col("p_brand"), "#").getItem(1).cast("int")
    cancelled = (F.col("l_returnflag") == "R") & (ok % 10 == 0) & (brand_no % 5 != 0)
    diverted = ok % 37 == 1
    qty = F.floor(F.col("l_quantity"))
    hop = F.abs(F.col("s_nationkey") - F.col("c_nationkey"))
    ship = F.col("l_shipdate")
    fmt = ln % 3
    fl_date = (F.when(pk % 97 == 5, F.lit("unknown"))
                .when(fmt == 0, F.date_format(ship, "yyyy-MM-dd"))
                .when(fmt == 1, F.date_format(ship, "yyyyMMdd"))
                .otherwise(F.date_format(ship, "MM/dd/yyyy")))
    base = (pk % 24) * 100 + sk % 60
    other = (pk % 24) * 100 + (sk % 60 + ln) % 60

    def seq(nk):
        return ((10000 + nk) * 100 + F.when((nk % 7 == 0) & (ln % 2 == 0), 2).otherwise(1)).cast("int")

    return j.select(
        (((ok * 100000 + pk) * 10000 + sk) * 10 + ln).cast("long").alias("FLIGHT_ID"),
        fl_date.alias("FL_DATE"),
        F.col("p_brand").alias("OP_UNIQUE_CARRIER"),
        (19000 + brand_no).cast("int").alias("OP_CARRIER_AIRLINE_ID"),
        F.col("p_brand").alias("OP_CARRIER"),
        F.concat(F.lit("N"), sk.cast("string")).alias("TAIL_NUM"),
        pk.cast("string").alias("OP_CARRIER_FL_NUM"),
        (10000 + F.col("s_nationkey")).cast("int").alias("ORIGIN_AIRPORT_ID"),
        seq(F.col("s_nationkey")).alias("ORIGIN_AIRPORT_SEQ_ID"),
        "ORIGIN_CITY_MARKET_ID", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_ABR",
        "ORIGIN_STATE_FIPS", "ORIGIN_STATE_NM", "ORIGIN_WAC",
        (10000 + F.col("c_nationkey")).cast("int").alias("DEST_AIRPORT_ID"),
        seq(F.col("c_nationkey")).alias("DEST_AIRPORT_SEQ_ID"),
        "DEST_CITY_MARKET_ID", "DEST", "DEST_CITY_NAME", "DEST_STATE_ABR",
        "DEST_STATE_FIPS", "DEST_STATE_NM", "DEST_WAC",
        _clock_raw(ok, base).alias("CRS_DEP_TIME"),
        _clock_raw(ok, other).alias("DEP_TIME"),
        _num_text(F.when(~cancelled, (qty - 25).cast("double"))).alias("DEP_DELAY"),
        _clock_raw(ok, other).alias("WHEELS_OFF"),
        _clock_raw(ok, other).alias("WHEELS_ON"),
        _clock_raw(ok, other).alias("CRS_ARR_TIME"),
        _clock_raw(ok, other).alias("ARR_TIME"),
        _num_text(F.when(~cancelled & ~diverted, (qty - 20).cast("double"))).alias("ARR_DELAY"),
        F.when(cancelled, 1.0).otherwise(0.0).alias("CANCELLED"),
        # blank (null) instead of 0.0 on some rows: exercises "null flag -> false"
        F.when(diverted, 1.0).when(ok % 37 == 2, F.lit(None).cast("double")).otherwise(0.0).alias("DIVERTED"),
        _num_text(F.when(~cancelled, (30 + 18 * hop + ln).cast("double"))).alias("AIR_TIME"),
        F.lit("1.0").alias("FLIGHTS"),
        (100 + 150 * hop).cast("double").cast("string").alias("DISTANCE"),
        # source columns that the pruning step drops
        F.year(ship).alias("Year"),
        F.month(ship).alias("Month"),
        (qty % 30).cast("double").alias("TaxiOut"),
        (1 + hop % 11).cast("int").alias("DistanceGroup"),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports dimension: one airport per nation, a second sequence row where
    n_nationkey % 7 == 0 (so an airport can fan out a join)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    n = nation.join(region, nation.n_regionkey == region.r_regionkey)
    base = n.select(
        (10000 + F.col("n_nationkey")).cast("int").alias("airport_id"),
        F.col("n_nationkey"),
        (30000 + F.col("n_nationkey")).cast("string").alias("city_market_id"),
        F.col("n_name").alias("code"),
        F.col("n_name").alias("city_name"),
        F.substring("r_name", 1, 2).alias("state_abr"),
        F.col("n_regionkey").cast("string").alias("state_fips"),
        F.col("r_name").alias("state_name"),
        F.col("n_regionkey").cast("int").alias("wac"),
    )
    seqs = F.when(F.col("n_nationkey") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (base.withColumn("_s", F.explode(seqs))
            .select("airport_id", (F.col("airport_id") * 100 + F.col("_s")).cast("int").alias("airport_seq_id"),
                    "city_market_id", "code", "city_name", "state_abr", "state_fips", "state_name", "wac"))


def _epoch(ts):
    """Whole epoch seconds of a wall-clock (timestamp_ntz) value read as UTC,
    independent of the session time zone."""
    utc = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                           F.second(ts).cast("decimal(8,6)"), F.lit("UTC"))
    return F.unix_seconds(utc)


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One REST state vector per event: ``state`` is array<string> (positional).

    Index 7 carries the "geo" altitude and 13 the "baro" one, as labelled by the
    reference producer. Rows with event_id % 97 == 3 are truncated to 16 values.
    """
    ev = table(spark, sf_dir, "events")
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    epoch = _epoch(F.col("ts"))
    last_contact = F.when(~((F.col("event_type") == "error") & (eid % 2 == 0)), epoch)
    vec = F.array(
        F.concat(F.lit("a"), uid.cast("string")),
        F.when(eid % 5 != 0, F.concat(F.lit("CS"), (eid % 900).cast("string"))),
        F.concat(F.lit("C"), (uid % 12).cast("string")),
        epoch.cast("string"),
        last_contact.cast("string"),
        (eid % 360 - 180).cast("string"),
        (uid % 180 - 90).cast("string"),
        (val * 10).cast("string"),
        F.lit("false"),
        F.when(eid % 50 == 7, F.lit("n/a")).otherwise(val.cast("string")),
        (eid % 360).cast("string"),
        (val - 20).cast("string"),
        F.lit(None).cast("string"),
        (val * 10 + 50).cast("string"),
        F.lpad((eid % 7777).cast("string"), 4, "0"),
        F.lit("false"),
        F.lit("0"),
    )
    vec = F.when(eid % 97 == 3, F.slice(vec, 1, 16)).otherwise(vec)
    return ev.select(eid.alias("seq"), vec.alias("state"))


def flight_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST flight list entries (signup events); ``seq`` gives list order."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    eid, uid = F.col("event_id"), F.col("user_id")
    epoch = _epoch(F.col("ts"))
    return ev.select(
        eid.alias("seq"),
        F.concat(F.lit("a"), uid.cast("string")).alias("icao24"),
        epoch.alias("firstSeen"),
        (epoch + 3600).alias("lastSeen"),
        F.concat(F.lit("D"), (uid % 5).cast("string")).alias("estDepartureAirport"),
        F.when(eid % 3 != 0, F.concat(F.lit("K"), (uid % 7).cast("string"))).alias("estArrivalAirport"),
    )
