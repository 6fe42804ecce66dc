"""Driver contract and an oracle subset on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from airmetrics.plans import catalog
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ROWS_ONLY = {"delay_model_metrics", "delay_model_scores"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns == ["state_name", "mean_delay"]


def test_every_query_has_oracle_or_is_listed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # the optional training-data queries, where present, are tested in their own folder
    own = set(catalog.all_queries())
    assert own <= set(q) and own - set(o) == ROWS_ONLY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", ["delay_by_state", "flight_counts", "parse_hhmm_times", "describe_flights",
                                  "page_flights", "enrich_states", "sql_window_frame", "regression_metrics",
                                  "distance_airtime_lowess", "csv_round_trip"])
def test_oracle_subset(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    sorder = [sdf.columns.index(dcols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in sorder) for r in sdf.collect()), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert a == b
