"""Window rules, filters and paging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airmetrics.operators import filters as flt

D = dt.date


def test_resolve_window_edges():
    hi, lo = D(2024, 12, 31), D(2020, 1, 1)
    w = flt.resolve_window("2030-01-01", "2031-01-01", lo, hi)
    assert (w.start, w.end) == (D(2024, 12, 31), D(2030, 1, 1)) and w.warning
    w = flt.resolve_window(None, None, lo, hi)
    assert (w.start, w.end, w.warning) == (D(2024, 1, 1), D(2024, 12, 31), None)
    w = flt.resolve_window("2025-01-01", None, lo, hi)  # default end never triggers a swap
    assert (w.start, w.end) == (D(2025, 1, 1), D(2024, 12, 31))
    w = flt.resolve_window("2024-03-01", "not-a-date", lo, hi)
    assert (w.start, w.end) == (D(2024, 3, 1), D(2024, 12, 31))


def test_apply_filters_skips_falsy_and_unknown(flights_small):
    f = flt.apply_filters(flights_small, {"op_carrier": ["Brand#1"], "nope": 3, "tail_num": "", "dest_airport_id": None})
    assert f.count() == flights_small.where(F.col("op_carrier") == "Brand#1").count()


def test_filter_airport_text_parameter(flights_small):
    a = flt.filter_airport(flights_small, "10001").count()
    b = flights_small.where((F.col("origin_airport_id") == 10001) | (F.col("dest_airport_id") == 10001)).count()
    assert a == b > 0
    assert flt.filter_airport(flights_small, "abc").count() == 0


def test_pages_concatenate_to_table(flights_small):
    n = flights_small.count()
    size = 1000
    ids = []
    for p in range(1, n // size + 2):
        ids += [r[0] for r in flt.page(flights_small.select("flight_id"), "flight_id", p, size).collect()]
    assert ids == sorted(r[0] for r in flights_small.select("flight_id").collect())


def test_keyset_page_matches_offset_page(flights_small):
    a = [r[0] for r in flt.page(flights_small.select("flight_id"), "flight_id", 3, 50).collect()]
    last = flt.page(flights_small.select("flight_id"), "flight_id", 2, 50).collect()[-1][0]
    b = [r[0] for r in flt.page_after(flights_small.select("flight_id"), "flight_id", last, 50).collect()]
    assert a == b


def test_page_bounds(flights_small):
    with pytest.raises(ValueError):
        flt.page(flights_small, "flight_id", 0, 10)
    with pytest.raises(ValueError):
        flt.page(flights_small, "flight_id", 1, 1001)


def test_empty_result_facets(flights_small):
    no_data, fac = flt.empty_result_facets(flt.filter_plane(flights_small, "no-such"), flights_small)
    assert no_data and fac.where(F.col("facet") == "airline").count() == 25


def test_route_filter_pushes_integer_predicates(spark, tmp_path, capsys):
    spark.range(10).selectExpr("cast(id + 10000 as int) as origin_airport_id",
                               "cast(id + 10002 as int) as dest_airport_id").write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f"))
    flt.filter_route(df, "10001 → 10003").explain(mode="formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(origin_airport_id,10001)" in plan


def test_deep_page_by_rank_equals_offset_page(spark):
    from airmetrics.operators.scan import ROWS_PER_BLOCK  # noqa: F401
    df = spark.range(0, 5000).selectExpr("id * 7 % 5003 as k", "id as v")
    exp = [r.k for r in df.orderBy("k").offset(2100).limit(50).collect()]
    got = [r.k for r in flt.page_by_rank(df, "k", 2100, 50).collect()]
    assert got == exp


def test_deep_page_multi_block(spark, monkeypatch):
    import airmetrics.operators.scan as scan
    monkeypatch.setattr(scan, "ROWS_PER_BLOCK", 500)
    monkeypatch.setattr(flt, "DEEP_PAGE_ROWS", 1000)
    df = spark.range(0, 5000).selectExpr("(id * 7919) % 5000 as k", "id as v")
    exp = [tuple(r) for r in df.orderBy("k").offset(3000).limit(40).collect()]
    got = [tuple(r) for r in flt.page(df, "k", 76, 40).collect()]
    assert got == exp
