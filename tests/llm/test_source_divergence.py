"""Operator 12 against brute force on small awkward tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from airmetrics.llm import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, v string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs=3, top=200):
    docs = [((l or ""), (s or ""), TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, l, s, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total = Counter(), Counter()
        per = defaultdict(Counter)
        for l, s, terms in docs:
            if l == lang:
                per[s].update(terms)
                total.update(terms)
                df.update(set(terms))
        kept = [t for t in df if df[t] >= least_docs]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}

        q = shares(total)
        p = {s: shares(c) for s, c in per.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in per:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in per if o != s)
            out += [(lang, s, "pair", o, -x, r + 1) for r, (x, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if per[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -x, r + 1) for r, (x, _, t) in enumerate(terms[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [rng.choice("aeiou") + "".join(rng.choice("bcdfghéßЖ日𝄞") for _ in range(rng.randrange(1, 4))) for _ in range(900)]
    out = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "é", "z", "", None, "s10"])
        text = " ".join(rng.choice(words[:60 + 40 * len(source or "")]).title() for _ in range(rng.randrange(0, 90)))
        out.append((i, text, lang, source, "x", 1, "y"))
    out += [(1, None, "de", "s1", "x", 1, "y"), (2, "", "de", "s2", "x", 1, "y"), (3, "7 .. 8", "de", None, "x", 1, "y"),
            (4, "one two", "it", "alone", "x", 1, "y"), (5, "Only ONCE here", "fr", "tail", "x", 1, "y"), out[7], out[7], (None, "abc abc", None, None, None, None, None),
            (6, "long " * 20_000 + "ab " * 30_000, "en", "z", "x", 1, "y")]
    return out


def found(df):
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_audit_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(source_divergence.audit(df)) == brute(rows)
    assert found(source_divergence.audit(df, least_docs=1, top=4)) == brute(rows, 1, 4)


def test_tiles_and_blocks_change_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(source_divergence.audit(df, tile=2, fine=16)) == brute(rows)


def test_skyband_holds_whatever_can_rank():
    rng = np.random.default_rng(6)
    for n in (10, 300, 5000):
        g, low = rng.zipf(1.6, n) % 1000, rng.zipf(1.4, n) % 5000
        keep = source_divergence.skyband(g, low, 20)
        counts = np.array([np.count_nonzero((g[:i] >= g[i]) & (low[:i] <= low[i])) for i in range(n)])
        assert (keep == (counts < 20)).all()
        assert n < 5000 or keep.sum() < n / 3


def test_skybands_of_partitions_merge(spark):
    rng = np.random.default_rng(8)
    rows = [("l", f"s{k % 2}", f"t{k:05d}", int(g), int(x)) for k, (g, x) in enumerate(zip(rng.zipf(1.7, 8000) % 500, rng.zipf(1.5, 8000) % 900))]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").repartition(6)
    once = source_divergence.partition_skybands(df.coalesce(1), 9).collect()
    twice = source_divergence.partition_skybands(source_divergence.partition_skybands(df, 9).coalesce(1), 9).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice)) and len(once) < 4000


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10 ** 13, 3 * 10 ** 13, 10 ** 6)], "n long, t long, v long")
    assert df.select(source_divergence.share(F.col("n"), F.col("t"), F.col("v"))).first()[0] == 1 + 10 ** 9 * (10 ** 13 + 1) // (3 * 10 ** 13 + 10 ** 6)


def test_empty_table(spark):
    assert found(source_divergence.audit(spark.createDataFrame([], SCHEMA))) == []
