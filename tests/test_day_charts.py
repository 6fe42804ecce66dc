"""Day sums that grow with the loads, and the tables of parts below them."""

import os

import pytest
from pyspark.sql import functions as F

from airmetrics.operators import filters as flt
from airmetrics.plans import catalog, dashboard, day_charts
from airmetrics.plans.queries_io import long_charts
from airmetrics.sources import versioned

from tests.conftest import SF_SMALL


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _long(found):
    return sorted((r["chart"], r["key"], round(r["value"], 6)) for r in long_charts(found).collect())


def test_loads_replacements_and_stale_answers(spark, flights_small, tmp_path):
    path, ports = str(tmp_path / "days"), catalog.airports(spark, SF_SMALL)
    columns = day_charts.schema(flights_small)
    late = F.date_format("fl_date", "yyyy-MM") == "1995-03"
    first, second = flights_small.where(~late & (F.col("flight_id") % 2 == 0)), flights_small.where(late)
    assert day_charts.add(first, path, "1")
    before = _files(path + "/rows")
    assert day_charts.add(second, path, "2")
    assert not day_charts.add(second, path, "2")  # a load taken twice counts once
    after = _files(path + "/rows")
    assert before.items() <= after.items()
    assert {f.split("part=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"1995-03"}
    with pytest.raises(day_charts.StaleCharts):
        day_charts.charts(spark, path, ports, columns, "1")
    both = first.union(second)

    def expect(rows, start, end):
        frame = flt.between_dates(rows, start, end)
        return _long({n: fn(frame) for n, fn in dashboard.chart_functions(ports).items()} | {"delay_by_airport": day_charts.dash.ch.delay_by_airport(frame)})

    window = ("1995-02-10", "1995-04-20")
    got = day_charts.charts(spark, path, ports, columns, "2", *window)
    assert _long(got) == expect(both, *window)
    facets = {tuple(r) for r in got["facets"].collect()}
    assert facets == {tuple(r) for r in flt.facets(flt.between_dates(both, *window)).collect()}
    lo, hi = both.agg(F.min("fl_date"), F.max("fl_date")).first()
    assert day_charts.bounds(spark, path, columns) == (lo, hi)
    # rows of a month are removed: only that month is recomputed
    day_charts.replace(both.where("flight_id % 4 <> 0"), path, "3", ["1995-04"])
    changed = both.where((F.date_format("fl_date", "yyyy-MM") != "1995-04") | (F.col("flight_id") % 4 != 0))
    assert _long(day_charts.charts(spark, path, ports, columns, "3", *window)) == expect(changed, *window)
    # a month without rows any more, several versions in one, and the folders nobody needs
    day_charts.replace(both.limit(0), path, "4", ["1995-03"])
    day_charts.add(second, path, "5")
    day_charts.add(first.where(F.date_format("fl_date", "yyyy-MM") == "1995-02"), path, "6")
    want = _long(day_charts.charts(spark, path, ports, columns, "6", *window))
    day_charts.compact(spark, path, columns)
    assert versioned.vacuum(spark, path) > 0
    assert _long(day_charts.charts(spark, path, ports, columns, "6", *window)) == want
    assert len({p for _, p in versioned.live(spark, path)}) == len(versioned.live(spark, path))


def test_only_the_months_of_the_window_are_read(spark, flights_small, tmp_path):
    path = str(tmp_path / "days")
    day_charts.add(flights_small, path, "1")
    columns = day_charts.schema(flights_small)
    got = day_charts.window_rows(spark, path, columns, "1995-02-10", "1995-04-20")
    assert {f.split("part=")[1].split("/")[0] for f in got.inputFiles()} == {"1995-02", "1995-03", "1995-04"}


def test_empty_store_and_writer_that_died(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT id, cast(id % 2 as string) AS part FROM range(6)")
    assert versioned.token(spark, path) is None and versioned.read(spark, path, rows.schema).count() == 0
    rows.write.partitionBy("part").parquet(f"{path}/rows/version=1")  # no line was written
    assert versioned.read(spark, path, rows.schema).count() == 0
    assert versioned.write(rows, path) == 1
    versioned.write(rows.where("part = '1'").limit(0), path, touched=["1"])
    assert {r["part"] for r in versioned.read(spark, path, rows.schema).collect()} == {"0"}
    assert versioned.read(spark, path, rows.schema).count() == 3
    versioned.write(rows.limit(0), path, "add", "x")
    assert versioned.token(spark, path) == "x" and versioned.read(spark, path, rows.schema).count() == 3
