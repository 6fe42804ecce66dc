"""Explicit schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# The 36 canonical column names of a cleaned on-time record,
# in their natural order. They must equal the reference's names.
CANONICAL_COLUMNS = [
    "FL_DATE", "OP_UNIQUE_CARRIER", "OP_CARRIER_AIRLINE_ID", "OP_CARRIER",
    "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN_AIRPORT_SEQ_ID",
    "ORIGIN_CITY_MARKET_ID", "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_STATE_ABR",
    "ORIGIN_STATE_FIPS", "ORIGIN_STATE_NM", "ORIGIN_WAC", "DEST_AIRPORT_ID",
    "DEST_AIRPORT_SEQ_ID", "DEST_CITY_MARKET_ID", "DEST", "DEST_CITY_NAME",
    "DEST_STATE_ABR", "DEST_STATE_FIPS", "DEST_STATE_NM", "DEST_WAC",
    "CRS_DEP_TIME", "DEP_TIME", "DEP_DELAY", "WHEELS_OFF", "WHEELS_ON",
    "CRS_ARR_TIME", "ARR_TIME", "ARR_DELAY", "CANCELLED", "DIVERTED",
    "AIR_TIME", "FLIGHTS", "DISTANCE",
]

# Public column names of the US on-time download for the kept columns, mapped to
# the canonical names above (C2). Names that are already canonical pass through.
SOURCE_TO_CANONICAL = {
    "FlightDate": "FL_DATE",
    "Reporting_Airline": "OP_UNIQUE_CARRIER",
    "DOT_ID_Reporting_Airline": "OP_CARRIER_AIRLINE_ID",
    "IATA_CODE_Reporting_Airline": "OP_CARRIER",
    "Flight_Number_Reporting_Airline": "OP_CARRIER_FL_NUM",
    "Tail_Number": "TAIL_NUM",
    "OriginAirportID": "ORIGIN_AIRPORT_ID",
    "OriginAirportSeqID": "ORIGIN_AIRPORT_SEQ_ID",
    "OriginCityMarketID": "ORIGIN_CITY_MARKET_ID",
    "Origin": "ORIGIN",
    "OriginCityName": "ORIGIN_CITY_NAME",
    "OriginState": "ORIGIN_STATE_ABR",
    "OriginStateFips": "ORIGIN_STATE_FIPS",
    "OriginStateName": "ORIGIN_STATE_NM",
    "OriginWac": "ORIGIN_WAC",
    "DestAirportID": "DEST_AIRPORT_ID",
    "DestAirportSeqID": "DEST_AIRPORT_SEQ_ID",
    "DestCityMarketID": "DEST_CITY_MARKET_ID",
    "Dest": "DEST",
    "DestCityName": "DEST_CITY_NAME",
    "DestState": "DEST_STATE_ABR",
    "DestStateFips": "DEST_STATE_FIPS",
    "DestStateName": "DEST_STATE_NM",
    "DestWac": "DEST_WAC",
    "CRSDepTime": "CRS_DEP_TIME",
    "DepTime": "DEP_TIME",
    "DepDelay": "DEP_DELAY",
    "WheelsOff": "WHEELS_OFF",
    "WheelsOn": "WHEELS_ON",
    "CRSArrTime": "CRS_ARR_TIME",
    "ArrTime": "ARR_TIME",
    "ArrDelay": "ARR_DELAY",
    "Cancelled": "CANCELLED",
    "Diverted": "DIVERTED",
    "AirTime": "AIR_TIME",
    "Flights": "FLIGHTS",
    "Distance": "DISTANCE",
}

CLOCK_COLUMNS = ["crs_dep_time", "dep_time", "wheels_off", "wheels_on", "crs_arr_time", "arr_time"]
NUMERIC_COLUMNS = ["dep_delay", "arr_delay", "air_time", "distance", "flights"]
FLAG_COLUMNS = ["cancelled", "diverted"]

AIRLINES = T.StructType([
    T.StructField("airline_id", T.IntegerType()),
    T.StructField("unique_carrier", T.StringType()),
])

AIRPORTS = T.StructType([
    T.StructField("airport_id", T.IntegerType()),
    T.StructField("airport_seq_id", T.IntegerType()),
    T.StructField("city_market_id", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("state_abr", T.StringType()),
    T.StructField("state_fips", T.StringType()),
    T.StructField("state_name", T.StringType()),
    T.StructField("wac", T.IntegerType()),
])

# Fact row. Clock columns are seconds of day (int); see functions.clean.
FLIGHTS = T.StructType([
    T.StructField("flight_id", T.LongType()),
    T.StructField("fl_date", T.DateType()),
    T.StructField("op_unique_carrier", T.StringType()),
    T.StructField("op_carrier_airline_id", T.IntegerType()),
    T.StructField("op_carrier", T.StringType()),
    T.StructField("tail_num", T.StringType()),
    T.StructField("op_carrier_fl_num", T.StringType()),
    T.StructField("origin_airport_id", T.IntegerType()),
    T.StructField("dest_airport_id", T.IntegerType()),
    T.StructField("crs_dep_time", T.IntegerType()),
    T.StructField("dep_time", T.IntegerType()),
    T.StructField("dep_delay", T.DoubleType()),
    T.StructField("wheels_off", T.IntegerType()),
    T.StructField("wheels_on", T.IntegerType()),
    T.StructField("crs_arr_time", T.IntegerType()),
    T.StructField("arr_time", T.IntegerType()),
    T.StructField("arr_delay", T.DoubleType()),
    T.StructField("cancelled", T.BooleanType()),
    T.StructField("diverted", T.BooleanType()),
    T.StructField("air_time", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("flights", T.DoubleType()),
])
FLIGHT_COLUMNS = [f.name for f in FLIGHTS.fields]

# Raw CSV: every column read as text; conversion is done by native expressions.
RAW_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ["FLIGHT_ID", "TAIL_NUM"] + CANONICAL_COLUMNS])

# Stream message (one aircraft position report).
POSITION = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("last_contact", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])
ALTITUDE = T.StructType([T.StructField("geo", T.DoubleType()), T.StructField("baro", T.DoubleType())])
MOVEMENT = T.StructType([
    T.StructField("velocity", T.DoubleType()),
    T.StructField("heading", T.DoubleType()),
    T.StructField("vertical_rate", T.DoubleType()),
])
FLIGHT_INFO = T.StructType([
    T.StructField("firstSeen", T.LongType()),
    T.StructField("lastSeen", T.LongType()),
    T.StructField("estDepartureAirport", T.StringType()),
    T.StructField("estArrivalAirport", T.StringType()),
])
MESSAGE = T.StructType([
    T.StructField("icao24", T.StringType()),
    T.StructField("callsign", T.StringType()),
    T.StructField("origin_country", T.StringType()),
    T.StructField("position", POSITION),
    T.StructField("altitude", ALTITUDE),
    T.StructField("movement", MOVEMENT),
    T.StructField("flight_info", FLIGHT_INFO),
])

FLIGHT_LIST_ENTRY = T.StructType([
    T.StructField("icao24", T.StringType()),
    T.StructField("firstSeen", T.LongType()),
    T.StructField("lastSeen", T.LongType()),
    T.StructField("estDepartureAirport", T.StringType()),
    T.StructField("estArrivalAirport", T.StringType()),
])

FLAT_POSITION = T.StructType([
    T.StructField("icao24", T.StringType()),
    T.StructField("origin_country", T.StringType()),
    T.StructField("time_position", T.LongType()),
    T.StructField("last_contact", T.LongType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude_geo", T.DoubleType()),
    T.StructField("altitude_baro", T.DoubleType()),
    T.StructField("velocity", T.DoubleType()),
    T.StructField("vertical_rate", T.DoubleType()),
    T.StructField("first_seen", T.LongType()),
    T.StructField("last_seen", T.LongType()),
    T.StructField("est_arrival_airport", T.StringType()),
])
