"""Edge tables for the cleaning expressions (FIXTURES.md section 6)."""

import datetime as dt
import math

from airmetrics.functions.clean import hhmm_to_seconds, parse_fl_date, seconds_to_hhmmss, to_bool, to_number


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


def test_hhmm_text(spark):
    vals = ["930", "930.7", "2400", "2359", "0", "-0.5", "2401", "1275", "-5", "", "x", "NaN", "Infinity", None]
    exp = [34200, 34200, 86399, 86340, 0, 0, None, None, None, None, None, None, None, None]
    assert _one(spark, vals, hhmm_to_seconds) == exp


def test_hhmm_numeric(spark):
    vals = [930.0, 930.7, 2400.0, -0.5, 2401.0, float("nan"), float("inf"), None]
    exp = [34200, 34200, 86399, 0, None, None, None, None]
    assert _one(spark, vals, hhmm_to_seconds, "double") == exp


def test_seconds_to_text(spark):
    assert _one(spark, [34200, 86399, 0, None], seconds_to_hhmmss, "int") == ["09:30:00", "23:59:59", "00:00:00", None]


def test_parse_fl_date(spark):
    vals = ["2018-01-02", "20180102", "1/2/2018", "01/02/2018", "03-04-2018", "13-04-2018",
            "1/1/2018 12:00:00 AM", "2018-01-01 10:00:00", "unknown", "2018-02-30", None, " 2018-01-02 "]
    d = dt.date
    exp = [d(2018, 1, 2), d(2018, 1, 2), d(2018, 1, 2), d(2018, 1, 2), d(2018, 3, 4), d(2018, 4, 13),
           d(2018, 1, 1), d(2018, 1, 1), None, None, None, d(2018, 1, 2)]
    assert _one(spark, vals, parse_fl_date) == exp


def test_to_bool(spark):
    assert _one(spark, [1.0, 0.0, None, 2.0], to_bool, "double") == [True, False, False, True]
    assert _one(spark, ["1.0", "0", "", "x"], to_bool) == [True, False, False, False]


def test_to_number(spark):
    out = _one(spark, ["-5.0", "", "n/a", "NaN", "12"], to_number)
    assert out[0] == -5.0 and out[1] is None and out[2] is None and out[3] is None and out[4] == 12.0
    assert not any(isinstance(v, float) and math.isnan(v) for v in out if v is not None)


def test_parse_iso_date_is_strict(spark):
    import pytest
    from airmetrics.functions.clean import parse_iso_date
    ok = spark.createDataFrame([("2018-01-02",)], "v string").select(parse_iso_date("v")).first()[0]
    assert ok == dt.date(2018, 1, 2)
    with pytest.raises(Exception):
        spark.createDataFrame([("02/01/2018",)], "v string").select(parse_iso_date("v")).collect()


def test_columns_without_reading_rows(spark):
    from airmetrics.operators.profile import columns
    df = spark.createDataFrame([], "a int, b string")
    assert columns(df) == [("a", "int"), ("b", "string")]


def test_canonical_names_from_source_names(spark):
    import pytest
    from airmetrics import schemas
    from airmetrics.operators.modelling import canonical_columns, canonical_names
    src = {v: k for k, v in schemas.SOURCE_TO_CANONICAL.items()}
    names = [src.get(c, c) for c in schemas.CANONICAL_COLUMNS] + ["TaxiOut", "Year"]
    df = spark.createDataFrame([tuple("1" for _ in names)], ", ".join(f"`{n}` string" for n in names))
    out = canonical_columns(df)
    assert out.columns == [c.lower() for c in schemas.CANONICAL_COLUMNS]
    with pytest.raises(ValueError):
        canonical_names(df.drop("FlightDate"))


def test_strict_iso_dates_of_other_layouts_are_null(spark):
    from airmetrics.functions.clean import parse_iso_date

    texts = ["2018-03-04", "2018-3-4", "04/03/2018", "20180304", "2018-02-30", "2018-03-04 00:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [str(r[0]) if r[0] else None for r in df.select(parse_iso_date("t", fail=False)).collect()] == ["2018-03-04"] + [None] * 7
