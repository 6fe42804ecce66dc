"""Chart rules and cross-chart properties."""

from pyspark.sql import functions as F

from airmetrics.operators import charts as ch
from airmetrics.operators import profile as prof
from airmetrics.operators.histogram import histogram, nice_width
from airmetrics.plans import catalog
from tests.conftest import SF_SMALL


def _d(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_cancellation_rate_drops_carriers_without_cancellations(flights_small):
    rates = ch.cancellation_rate(flights_small, n=100)
    none = flights_small.groupBy("op_carrier").agg(F.count_if("cancelled").alias("c")).where("c = 0")
    absent = {r[0] for r in none.collect()}
    assert absent and absent.isdisjoint({r[0] for r in rates.collect()})


def test_counts_dominate_cancellations(flights_small):
    all_ = _d(ch.flight_counts(flights_small, n=100), "op_carrier", "flights")
    canc = _d(ch.cancelled_flights(flights_small, n=100), "op_carrier", "cancelled_count")
    assert all(all_[k] >= v for k, v in canc.items())


def test_daily_counts_sum_to_rows(flights_small):
    total = ch.flights_by_date(flights_small).agg(F.sum("n_flights")).first()[0]
    assert total == flights_small.where(F.col("fl_date").isNotNull()).count()


def test_weekday_and_month_means_pool_to_overall(flights_small):
    base = flights_small.where(F.col("fl_date").isNotNull() & F.col("arr_delay").isNotNull())
    overall = base.agg(F.avg("arr_delay")).first()[0]
    counts = _d(base.groupBy(ch.iso_weekday(F.col("fl_date")).alias("k")).count(), "k", "count")
    wk = _d(ch.delay_by_weekday(flights_small), "weekday_no", "avg_delay")
    pooled = sum(wk[k] * counts[k] for k in wk) / sum(counts.values())
    assert abs(pooled - overall) < 1e-9


def test_result_unchanged_under_repartition(flights_small):
    a = sorted(ch.delay_by_airline(flights_small).collect())
    b = sorted(ch.delay_by_airline(flights_small.repartition(17, "flight_id")).collect())
    assert a == b


def test_fanout_counts_twice(spark, flights_small):
    airports = catalog.airports(spark, SF_SMALL)
    from airmetrics.operators.joins import flights_with_airports
    one = flights_with_airports(flights_small, airports).count()
    two = flights_with_airports(flights_small, airports, fanout=True).count()
    dup = flights_small.where(((F.col("origin_airport_id") - 10000) % 7) == 0).count()
    assert two - one == dup > 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    rows = histogram(df, "v", 50).collect()
    assert [(r.bin_start, r.bin_end, r.n) for r in rows] == [(5.0, 6.0, 2)]
    assert histogram(df.where("v is null"), "v", 50).count() == 0
    assert nice_width(-19, 30, 50) == 1.0 and nice_width(0, 1000, 50) == 50.0
    vals = spark.range(1000).selectExpr("cast(id as double) * 0.37 as v")
    assert histogram(vals, "v", 30).count() <= 30


def test_describe_quartiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    d = {r.stat: r.value for r in prof.describe(df, ["x"]).collect()}
    for p, k in [(25, "25%"), (50, "50%"), (75, "75%")]:
        assert abs(d[k] - np.percentile(vals, p)) < 1e-12
    assert abs(d["std"] - np.std(vals, ddof=1)) < 1e-8


def test_head_is_key_ordered(flights_small):
    ids = [r.flight_id for r in prof.head(flights_small, 5).collect()]
    assert ids == sorted(ids) and len(ids) == 5


def test_single_pass_summary_equals_per_chart(spark, flights_small):
    from airmetrics.plans import dashboard as dash
    from airmetrics.operators import filters as flt
    airports = catalog.airports(spark, SF_SMALL)
    summary = dash.chart_summary(flights_small)
    keyed = dash.charts_from_summary(summary, airports)
    per_chart = dash.chart_functions(airports)
    per_chart["delay_by_airport"] = ch.delay_by_airport

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for name, df in keyed.items():
        assert df.columns == per_chart[name](flights_small).columns, name
        assert rows(df) == rows(per_chart[name](flights_small)), name
    assert rows(dash.facets_from_summary(summary)) == rows(flt.facets(flights_small))


def test_dashboard_concurrent_collect_equals_sequential(spark, flights_small):
    from airmetrics.plans import dashboard as dash
    airports = catalog.airports(spark, SF_SMALL)
    d = dash.dashboard(flights_small, airports, with_lowess=False)
    par = d.collect(parallel=8)
    seq = {name: build().collect() for name, build in d.builders.items()}
    for name, rows in seq.items():
        assert sorted(map(tuple, rows)) == sorted(map(tuple, par[name])), name
    assert sorted(map(tuple, par["facets"])) == sorted(map(tuple, d.facets.collect()))
    d.release()


def test_dashboard_no_data(spark, flights_small):
    from airmetrics.plans import dashboard as dash
    d = dash.dashboard(flights_small, catalog.airports(spark, SF_SMALL), plane="no-such-flight")
    assert d.no_data and d.builders == {} and d.facets.count() > 0
    d.release()
