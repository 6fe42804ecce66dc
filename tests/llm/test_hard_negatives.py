"""Operator 13 against brute force on small awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airmetrics.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score long, slot string, q int"


def brute(rows, positives=5, negatives=5, low=80):
    ok = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, l, v, *_ in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = sorted({(i, l, tuple(v)) for i, l, v in ok if i % 100 == 0})
    out = []
    for i, l, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok]
        for s, p in sorted((s, j) for s, j, m in scored if m == l and j != i)[:positives]:
            fits = sorted((t, j) for t, j, m in scored if m != l and low * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fits)]
    return sorted(out)


def found(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 20)) + 0.4
    out = []
    for i in range(900):
        v = centres[i % 6] + rng.normal(size=20) * 0.6
        out.append((i, int(rng.integers(0, 4)) if i % 3 else 1, [float(np.float32(x)) for x in v / 3], 1, "s", 2))
    out += [out[5], out[100], out[101], (950, 1, out[7][2], 1, "s", 2), (951, 2, out[7][2], 1, "s", 2)]  # repeated rows and ties
    out += [(None, 1, out[3][2], 1, None, None), (1000, None, out[3][2], 1, None, None), (1100, 1, None, 1, None, None),
            (1200, 1, [float("nan")] * 20, 1, None, None), (1300, 2, [0.1] * 19 + [None], 1, None, None), (1400, 3, [], 1, None, None),
            (1500, 2, [float("inf")] * 20, 1, None, None), (1600, 0, [0.5] * 3, 1, None, None), (1700, 9, [0.3] * 20, 1, None, None)]
    return out


def test_hard_negatives_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 100
    assert found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == want
    assert found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, block=3)) == want


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    q = rng.integers(-300, 300, size=(200, 32)).astype(np.int64)
    q[:20] = 7
    cut = hard_negatives._cut(hard_negatives.summary(q))
    exact, before = (q @ q.T).astype(float), None
    for n, (mean, dev) in zip(hard_negatives.LEVELS, cut):
        middle, spread = mean @ mean.T * (32 // n), dev @ dev.T
        assert (middle - spread <= exact + 1e-3).all() and (exact <= middle + spread + 1e-3).all()
        if before is not None:
            assert spread.sum() < before  # more segments, closer bounds
        before = spread.sum()


def test_most_pairs_are_dropped_before_exact_scoring(monkeypatch):
    rng = np.random.default_rng(2)
    step = np.repeat(rng.normal(size=(400, 4)), 8, axis=1)  # vectors whose segments tell much
    q = np.floor(256 * (step + rng.normal(size=(400, 32)) * 0.01)).astype(np.int64)
    side = hard_negatives.Side(np.arange(400), np.zeros(400), q, hard_negatives.summary(q))
    exact = q @ q.T
    fifth = np.sort(exact, axis=1)[:, -5].astype(float)
    i, j, score = hard_negatives.scored_pairs(side, side, np.ones((400, 400), bool), fifth, np.full(400, np.inf))
    assert (score == exact[i, j]).all() and len(i) < 6 * 400
    assert (np.bincount(i[score >= fifth[i]], minlength=400) >= 5).all()


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    rows = [(100 * k + e, e % 2, [2.0 ** 18 * (k + 1), -1e5 * e, 3.0, float(k)], 1, "s", 1) for k in range(6) for e in range(5)]
    df = spark.createDataFrame(rows + [(7, 1, [1e30, 0.0], 1, "s", 1)], SCHEMA)
    assert found(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == brute(rows) != []
    assert found(hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)) == []
