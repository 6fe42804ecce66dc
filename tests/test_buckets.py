"""Upserts that rewrite only the buckets of their keys."""

import os

import pytest

from airmetrics.sources import buckets, versioned


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.sql("SELECT id AS k, cast(id AS string) AS name, 0 AS n FROM range(1000)")
    buckets.create(rows, path, ["k"], 32)
    before = _files(path + "/rows")
    updates = spark.sql("SELECT 'seven' AS name, 1 AS n, 7L AS k UNION ALL SELECT 'new', 2, 5000L")
    touched = buckets.upsert(updates, path, rows.schema, ["k"])
    after = _files(path + "/rows")
    assert 1 <= len(touched) <= 2 and before.items() <= after.items()
    assert {f.split("part=")[1].split("/")[0] for f in after.keys() - before.keys()} == set(touched)
    want = sorted([(k, str(k), 0) for k in range(1000) if k != 7] + [(7, "seven", 1), (5000, "new", 2)], key=repr)
    assert _rows(buckets.table(spark, path, rows.schema)) == want
    assert buckets.upsert(updates, path, rows.schema, ["k"]) == touched  # again: the same table
    assert _rows(buckets.table(spark, path, rows.schema)) == want
    assert buckets.upsert(updates.limit(0), path, rows.schema, ["k"]) == []
    one = buckets.lookup(spark, path, rows.schema, {"k": 7})
    assert _rows(one) == [(7, "seven", 1)] and len(one.inputFiles()) < 32
    versioned.vacuum(spark, path)
    assert _rows(buckets.table(spark, path, rows.schema)) == want
    assert before.items() & _files(path + "/rows").items()


def test_null_keys_repeated_updates_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", None, "old"), ("a", 1, "old"), (None, 1, "old")], "x string, y int, v string")
    buckets.create(rows, path, ["x", "y"], 4)
    updates = spark.createDataFrame([("a", None, "p", 1), ("a", None, "q", None), (None, 1, "r", 5), (None, 1, "b", 9), ("z", 0, None, None)],
                                    "x string, y int, v string, at int")
    buckets.upsert(updates, path, rows.schema, ["x", "y"], order="at")
    assert _rows(buckets.table(spark, path, rows.schema)) == sorted(
        [("a", None, "p"), ("a", 1, "old"), (None, 1, "b"), ("z", 0, None)], key=repr)
    with pytest.raises(ValueError):
        buckets.create(rows.withColumnRenamed("v", "part"), str(tmp_path / "u"), ["x"])


def test_table_of_keys_alone_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0).select("id")
    buckets.create(rows, path, ["id"], 4)
    assert buckets.table(spark, path, rows.schema).count() == 0
    buckets.upsert(spark.range(5).union(spark.range(3)), path, rows.schema, ["id"])
    assert _rows(buckets.table(spark, path, rows.schema)) == [(i,) for i in range(5)]
