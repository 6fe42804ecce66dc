"""Distributed scans, exact quantiles and LOWESS against brute force."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airmetrics.operators.lowess import lowess
from airmetrics.operators.scan import exact_quantiles, prefix_scan


@pytest.mark.parametrize("blocks", [1, 5])
def test_prefix_scan_matches_global_window(spark, blocks):
    rng = np.random.default_rng(7)
    keys = rng.permutation(500).astype(float) * 1.5
    vals = rng.integers(-50, 50, 500)
    df = spark.createDataFrame([(float(k), int(v), (int(v) if v % 3 else None)) for k, v in zip(keys, vals)],
                               "k double, v long, m long")
    got = prefix_scan(df, "k", {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "m")},
                      blocks=blocks).orderBy("k").collect()
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"),
                    F.max("v").over(w).alias("hi"), F.last("m", True).over(w).alias("last")).orderBy("k").collect()
    assert [(r.k, r.s, r.lo, r.hi, r.last) for r in got] == [(r.k, r.s, r.lo, r.hi, r["last"]) for r in exp]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 40, 1001).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "x", probs).first()
    for i, p in enumerate(probs):
        assert abs(got[f"q{i}"] - np.quantile(vals, p)) < 1e-9


def test_column_quantiles(spark):
    """Several columns at once: a hot value, nulls, an empty column; an empty table."""
    from airmetrics.operators.profile import column_quantiles

    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 9, 700), rng.integers(0, 5, 700).astype(float)
    rows = [(float(x), None if i % 7 == 0 else int(y) if i % 3 else 2, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "x double, y int, z double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["column_name"]: [r[f"q{i}"] for i in range(5)] for r in column_quantiles(df, ["x", "y", "z"], probs).collect()}
    assert np.allclose(got["x"], np.quantile(a, probs))
    assert np.allclose(got["y"], np.quantile([r[1] for r in rows if r[1] is not None], probs))
    assert got["z"] == [None] * 5
    assert [r["q0"] for r in column_quantiles(df.limit(0), ["x", "y"], [0.5]).collect()] == [None, None]


def brute_lowess(x, y, frac, iterations=0):
    """The definition, row by row: k nearest rows give the radius, tricube weights,
    weighted linear fit; robustness passes reweight rows by the bisquare of
    residual / (6 * median |residual|)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k = max(1, int(frac * n + 1e-10))
    rw = np.ones(n)
    xs = np.unique(x)
    h = {x0: np.sort(np.abs(x - x0))[k - 1] for x0 in xs}
    for it in range(iterations + 1):
        out = {}
        for x0 in xs:
            d = np.abs(x - x0)
            if h[x0] == 0:
                w = (d == 0).astype(float)
            else:
                u = d / h[x0]
                w = np.where(d < h[x0], (1 - u ** 3) ** 3, 0.0)
            w = w * rw
            sw = w.sum()
            xb = (w * x).sum() / sw
            yb = (w * y).sum() / sw
            var = (w * x * x).sum() / sw - xb * xb
            cov = (w * x * y).sum() / sw - xb * yb
            out[x0] = yb + (x0 - xb) * cov / var if var > 1e-9 * (xb * xb + 1) else yb
        if it < iterations:
            r = np.abs(y - np.array([out[v] for v in x]))
            m = np.median(r)
            if m == 0:
                rw = (r == 0).astype(float)
            else:
                u = np.minimum(r / (6.0 * m), 1.0)
                rw = (1 - u ** 2) ** 2
    return out


@pytest.mark.parametrize("blocks,frac,its,direct", [(None, 2 / 3, 0, 0), (3, 0.2, 0, 0), (4, 0.3, 2, 0), (None, 0.05, 2, 200)])
def test_lowess_brute_force(spark, blocks, frac, its, direct):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 60, 700).astype(float) * 2.5
    y = 3 + 0.4 * x + rng.normal(0, 5, 700) + np.where(rng.random(700) < 0.05, 80.0, 0.0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.x: r.fitted for r in lowess(df, "x", "y", frac=frac, iterations=its, blocks=blocks,
                                         digits=None, direct=direct).collect()}
    exp = brute_lowess(x, y, frac, its)
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-6, (k, got[k], exp[k])


def test_lowess_heavy_value(spark):
    """One x value holds most rows (h = 0 at that value)."""
    x = [5.0] * 80 + [1.0, 2.0, 9.0, 12.0] * 5
    y = [float(i % 7) for i in range(len(x))]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    exp = brute_lowess(x, y, 0.6666666)
    for direct in (0, 200):
        got = {r.x: r.fitted for r in lowess(df, "x", "y", iterations=0, digits=None, direct=direct).collect()}
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-6


@pytest.mark.parametrize("bound", [200_000, 10])
def test_lowess_narrow_windows_beside_wide_gaps(spark, monkeypatch, bound):
    """Radii from 0.01 to 1e6 in one input; with the small bound every join is a shuffle join."""
    import airmetrics.operators.lowess as lw
    monkeypatch.setattr(lw, "DEFAULT_BROADCAST_ROWS", bound)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.random(300), 3), 5000 + rng.integers(0, 40, 200) / 2, [1e6, 2e6, -3e6]])
    y = 1 + 2 * (x % 7) + rng.normal(0, 2, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.x: r.fitted for r in lw.lowess(df, "x", "y", frac=0.1, iterations=1, digits=None).collect()}
    exp = brute_lowess(x, y, 0.1, 1)
    assert set(got) == set(exp) and all(abs(got[k] - exp[k]) < 1e-6 * max(1, abs(exp[k])) for k in exp)


@pytest.mark.parametrize("g", [2000])
def test_lowess_writes_rows_in_proportion_to_the_values(spark, monkeypatch, g):
    import airmetrics.operators.lowess as lw
    written, cut = [], lw.cut_lineage

    def counting(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(lw, "cut_lineage", counting)
    df = spark.range(g).select(F.col("id").cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"))
    assert lw.lowess(df, "x", "y", iterations=1).count() == g
    assert written and max(written) <= 3 * g


@pytest.mark.parametrize("n", [1, 7, 64])
def test_blocks_make_up_their_range(spark, n):
    from airmetrics.operators.lowess import _block_list
    ranges = [(a, b) for a in range(n + 1) for b in range(a, n + 1)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", _block_list("a", "b", n, 1).alias("p")).collect()
    for r in rows:
        covered = sorted(i for p in r.p for i in range(p.b << p.l, (p.b + 1) << p.l))
        assert covered == list(range(r.a, r.b)) and len(r.p) <= 2 * n.bit_length()
