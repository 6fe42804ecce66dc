"""pages of any key at any depth against a plain sort."""

import pytest

from airmetrics.operators import filters as flt
from airmetrics.operators import paging


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paging") / "t")
    # text keys that repeat, one of them in a third of the rows; nulls; a number that makes rows unique
    spark.sql("""SELECT if(id % 3 = 0, 'hot', if(id % 101 = 0, null, concat('k', lpad(id * 7919 % 5003, 5, '0')))) AS name,
                 if(id % 97 = 0, null, id * 31 % 700) AS grp, id * 104729 % 600011 AS id, map('a', id) AS m
                 FROM range(600000)""").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("keys", [["id"], ["name"], ["name", "grp"], ["grp", "name", "id"]])
def test_pages_equal_a_plain_sort(rows, keys):
    order = paging.total_order(rows, keys)
    assert "m" not in order
    want = [r["id"] for r in rows.orderBy(*order).select("id").collect()]
    for offset in (0, 99_950, 100_050, 500_000, 599_980):
        got = [r["id"] for r in paging.page_at(rows, keys, offset, 100, 5_000).collect()]
        assert got == want[offset:offset + 100], offset
    assert [r["id"] for r in flt.page(rows, keys, 5_001, 100).collect()] == want[500_000:500_100]
    assert paging.page_at(rows, keys, 600_000, 10).count() == 0


def test_rows_that_are_all_alike(spark):
    rows = spark.sql("SELECT if(id < 30000, 'a', if(id < 59990, 'b', null)) AS k, 1 AS v FROM range(60000)")
    for offset, want in ((0, [None] * 10 + ["a"] * 10), (30_000, ["a"] * 10 + ["b"] * 10), (59_990, ["b"] * 10)):
        assert [r["k"] for r in paging.page_at(rows, ["k"], offset, 20, 500).collect()] == want


def test_keyset_pages_of_a_composite_key(rows):
    order = ["grp", "name", "id"]
    want = [tuple(r) for r in rows.orderBy(*order).select(*order).limit(60).collect()]
    got, last = [], None
    for _ in range(3):
        got += (part := [tuple(r) for r in flt.page_after(rows.select(*order), order, last, 20).collect()])
        last = part[-1]
    assert got == want
    plan = flt.page_after(rows, ["id", "name"], (500, "k"), 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,500)" in plan


def test_other_types_and_empty_table(spark):
    rows = spark.sql("SELECT date_add(DATE '2020-01-01', cast(id % 800 AS int)) AS d, cast(id AS decimal(12, 2)) / 3 AS p, "
                     "if(id % 50 = 0, double('nan'), id / 7D) AS x, cast(id % 9 AS string) AS part FROM range(20000)")
    for keys in (["d"], ["x"], ["p"]):
        order = paging.total_order(rows, keys)
        want = [str(tuple(r)) for r in rows.select(*order).orderBy(*order).offset(15_000).limit(30).collect()]
        assert [str(tuple(r)) for r in paging.page_at(rows.select(*order), keys, 15_000, 30, 400).collect()] == want
    assert paging.page_at(rows.limit(0), ["d"], 0, 10).count() == 0
