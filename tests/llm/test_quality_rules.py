"""Operator 11 against brute force on small awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from airmetrics.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, common string, runs int, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def classes(text):
    kind = lambda ch: (0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in " \t\n\x0b\x0c\r"
                       else 4 if ch in "#*$%&|<>" else 5 if ord(ch) > 127 else 6)
    return Counter(kind(ch) for ch in text or "")


def distance(a, b):
    sa, sb = sum(a.values()), sum(b.values())
    js = 0.0
    for k in set(a) | set(b):
        p, q = a[k] / sa, b[k] / sb
        js += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x) / 2
    return round(math.sqrt(max(js, 0)), 6)


def brute(rows, class_limit=0.25, word_limit=0.37, least_words=50, least_reference=5000, n_common=40, common_share=0.05):
    docs = [(i, t or "", lang or "", base(t)) for i, t, lang, *_ in rows]
    out = []
    for lang in {d[2] for d in docs}:
        mine = [d for d in docs if d[2] == lang]
        df = Counter(w for d in mine for w in set(WORD.findall(d[1].lower())))
        common = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0].encode())) if n >= len(mine) * common_share][:n_common]
        place = {w: k for k, w in enumerate(common)}
        hist = lambda t: Counter(place.get(w, -1) for w in WORD.findall(t.lower()))
        c_ref, w_ref, total = Counter(), Counter(), 0
        for _, t, _, b in mine:
            if not b[5] and b[0] >= least_words:
                c_ref += classes(t)
                w_ref += hist(t)
                total += b[0]
        for i, t, _, b in mine:
            far = False
            if b[0] >= least_words and total >= least_reference:
                far = distance(classes(t), c_ref) > class_limit or distance(hist(t), w_ref) > word_limit
            out.append((i, *b, not b[5] and not far))
    return sorted(out, key=repr)


def found(df):
    cols = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    common = {"en": ["the", "of", "and", "to"], "fr": ["le", "été", "Ça", "de"], None: ["und", "der", "ß", "日本"]}
    texts = []
    for i in range(160):
        lang = rng.choice(["en", "en", "fr", None])
        words = [rng.choice(common[lang]) if rng.random() < 0.4 else "".join(rng.choice("abcdeé") for _ in range(5)) + rng.choice(["", ".", ",\n"])
                 for _ in range(rng.randrange(10, 200))]
        if i % 9 == 0:
            words = [w.upper() + "$$$ |" for w in words]
        if i % 10 == 0:
            words = words[:15] + words[:12] * 3 + words[15:]
        texts.append((i, rng.choice([" ", "\t ", "\n", "  "]).join(words), lang, "c", 1, "x"))
    block = "one two three four five six seven eight\n"
    more = [None, "", " \n\t", "\n\n", "one", "a\x00b c d   e", block * 2, block * 400, "same line\n" * 30 + "other\r\nother\n", "𝄞é " * 60,
            " ".join(f"w{k}" for k in range(60_000)), " ".join(f"w{k % 20_000}" for k in range(41_000)), "x" * 300_000]
    out = texts + [(1000 + k, t, "en", "c", 1, "x") for k, t in enumerate(more)] + [(2000, "the of and to " * 5, "small", None, None, None)]
    return [*out, texts[3], texts[3], (None, texts[4][1], "fr", None, None, None)]


def test_quality_rules_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for options in ({}, {"least_reference": 100, "least_words": 10, "n_common": 3, "word_limit": 0.2, "class_limit": 0.12}):
        want = brute(rows, **options)
        assert found(quality_rules.judge(df, **options)) == want
        assert {r[-1] for r in want if not r[-2]} == {True, False}


def test_no_python_runs_in_the_tasks(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert found(quality_rules.judge(spark.createDataFrame([], SCHEMA))) == []
