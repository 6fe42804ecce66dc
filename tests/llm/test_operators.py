"""The training-data operators against brute force on small, awkward tables."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from airmetrics.llm import (decontaminate, embeddings, jaccard, packing, secrets_scan, substrings, suffix_merge,
                            tokenfile, toxicity, warc)
from airmetrics.llm.tokens import PieceEncoder
from airmetrics.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# columns named like the operators' own, to clash with them
SCHEMA = "doc_id long, text string, row string, n_links long, score double"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "idea", "Éau", "stone", "river", "made", "x1", "water,", "long."]) + str(rng.randrange(40))
                    for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = prose(rng, 90)
    base = prose(rng, 200)
    texts = [None, "", " ", "one", "a b c d", base, base, base[:-30] + " changed words here", prose(rng, 50) + " " + shared + " " + prose(rng, 40),
             shared, prose(rng, 30) + "\n" + shared + prose(rng, 300), "a" * 1500, "ab " * 900, "日本語 " * 300, prose(rng, 4000)]
    out = [(i, t, "r", 1, 0.5) for i, t in enumerate(texts)]
    return [*out, out[8], (None, shared, None, None, None), (5, prose(rng, 60), "same id", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_piece_encoder_equals_the_library():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "a", "Z", "é", "×", "—", " ", "7", ".", "!!", "日本", "<|endoftext|>", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    enc = PieceEncoder(TOKENIZER, limit=3000)
    got = [ids[o[k]:o[k + 1]].tolist() for _, ids, o in enc.batches(pa.array(texts)) for k in range(len(o) - 1)]
    assert got == [e.ids for e in enc._tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_covers_every_id_once(docs, rows, nothing):
    tok = PieceEncoder(TOKENIZER)._tok
    got = packing.pack(docs, TOKENIZER, buffer_docs=4).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want[(i, len(ids), zlib.crc32(np.array(ids[:1024], "<u4").tobytes()) if len(ids) >= 1024 else None)] += 1
    assert sum(r.length for r in got) == sum(n * k[1] for k, n in want.items())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_token_file_round_trip(spark, docs, rows, nothing):
    tok = PieceEncoder(TOKENIZER)._tok
    path = scratch_path(spark, f"t-tokens-{random.random()}")
    tokenfile.write_tokens(docs, path, TOKENIZER, frame_ids=500)
    got = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    ids = Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == ids
    start = 0
    for r in got:
        assert (r.start, r.ids_crc32) == (start, zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    empty = scratch_path(spark, f"t-tokens-{random.random()}")
    tokenfile.write_tokens(nothing, empty, TOKENIZER)


def test_patched_blocks_hold_outliers():
    rng = np.random.default_rng(1)
    for n in (1, 127, 128, 5000):
        ids = rng.integers(0, 300, n).astype(np.uint32)
        ids[rng.random(n) < 0.03] = 2**32 - 5
        raw, blocks, odd = tokenfile.encode_ids(ids)
        assert (tokenfile.decode_ids(memoryview(raw), n, blocks, odd) == ids).all()


def test_bad_frame_is_refused():
    raw = tokenfile.frame(0, 0, [1], np.array([3]), np.array([5, 6, 7], np.uint32)) + tokenfile.FOOTER.encode()
    assert list(tokenfile.frames(raw))[0][4].tolist() == [5, 6, 7]
    with pytest.raises(ValueError):
        list(tokenfile.frames(raw[:60] + bytes([raw[60] ^ 1]) + raw[61:]))


def record(n, body=b"payload"):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n" \
           f"WARC-Block-Digest: sha1:{warc._digest(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("wrap", [lambda x: x, gzip.compress])
def test_salvage_loses_only_the_damaged_record(wrap):
    good = [wrap(record(n, b"p%d" % n * 50)) for n in range(4)]
    broken = good[1][:len(good[1]) - 20] + bytes([good[1][-20] ^ 255]) + good[1][-19:]
    raw = good[0] + broken + b"junk" + good[2] + good[3][:30]
    found = list(warc.salvage(raw))
    assert [x[2]["warc-record-id"] for x in found if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>"]
    gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
    assert gaps == [(len(good[0]), len(broken) + 4), (len(raw) - 30, 30)]


def test_warc_pages(spark):
    data = [(1, "u", "same"), (2, "u\nv", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\nx"), (None, "u", "same"), (2, "u", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark, f"t-warc-{random.random()}")
    warc.write_warc(pages, path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.page_rows(warc.read_warc(spark, path)).collect())
    d = lambda s: warc._digest(s.encode())
    assert got == Counter([(1, 4, d("same"), "revisit", 2), (2, 4, d("same"), "response", None), (2, 4, d("same"), "response", None),
                           (None, 4, d("same"), "revisit", 2), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None),
                           (5, 15, d(data[4][2]), "response", None)])


def test_contamination_equals_brute_force(spark, docs, rows):
    words = WORD.findall(lower(rows[9][1]))
    items = [(1, " ".join(words[3:20])), (2, " ".join(words[40:44])), (3, None), (4, "..."), (None, " ".join(words[50:64])), (2, "never seen"), (7, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add("null" if i is None else str(i))
    want = Counter()
    for i, t, *_ in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want[(i, len(w), len(hit), len(found), decontaminate.items_sha256(list(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    for block in (200_000, 3):
        got = decontaminate.digest(decontaminate.contamination(docs, bench, block_windows=block))
        assert Counter(map(tuple, got.collect())) == want
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(rows)


def test_benchmark_reaches_the_driver_by_the_block(spark, monkeypatch):
    """300 windows in blocks of about 30: the driver never sees more at a time, and the hits are those of one block."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(42)) for _ in range(10)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words {t[10:-10]} more") for i, t in enumerate(texts)], "doc_id long, text string")
    whole = Counter(map(tuple, decontaminate.digest(decontaminate.contamination(docs, bench)).collect()))
    sizes, shingles = [], decontaminate._shingles
    monkeypatch.setattr(decontaminate, "_shingles", lambda w, k: sizes.append(len(w)) or shingles(w, k))
    monkeypatch.setattr(type(bench), "toLocalIterator", lambda *a, **b: pytest.fail("the benchmark is pulled to the driver"))
    got = decontaminate.digest(decontaminate.contamination(docs, bench, block_windows=30))
    assert Counter(map(tuple, got.collect())) == whole and len(sizes) == 20 and sum(sizes) == 600 and max(sizes) <= 60
    assert all(r[2] > 0 for r in whole)


def repeated(units, length):
    seen = Counter(tuple(u[i:i + length]) if isinstance(u, list) else u[i:i + length] for u in units for i in range(len(u) - length + 1))
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i:i + length]) if isinstance(u, list) else u[i:i + length]] > 1:
                gone[i:i + length] = True
        yield gone


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup_equals_brute_force(docs, rows, hot):
    words = [(r[1] or "").encode().split() for r in rows]
    want = Counter((r[0], len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest())
                   for r, w, g in zip(rows, words, repeated(words, 35)))
    assert Counter(map(tuple, substrings.remove_repeats(docs, hot=hot).collect())) == want


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_equals_brute_force(docs, rows, hot):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, g in zip(rows, texts, repeated(texts, 400)):
        spans = int((g[1:] & ~g[:-1]).sum() + (g[0] if len(g) else 0))
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        want[(r[0], len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffix_merge.remove_repeats(docs, hot=hot, shard_units=3000).collect())) == want


def test_substring_operators_on_an_empty_table(nothing):
    assert substrings.remove_repeats(nothing).count() == 0
    assert suffix_merge.remove_repeats(nothing).count() == 0


def test_jaccard_join_equals_brute_force(spark, docs, rows, nothing):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link = [[a != b and bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(len(rows))] for a in range(len(rows))]
    want = Counter((r[0], sum(link[k])) for k, r in enumerate(rows))
    got = jaccard.jaccard_join(docs, limit=2, block=2).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == want
    classes = {(r.doc_id, r.text_hash): r.class_id for r in got}
    assert len({c for (i, _), c in classes.items() if i in (5, 6, 7)} - {5}) <= 1
    assert jaccard.jaccard_join(nothing).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 16))
    for a in range(0, 300, 3):
        v[a + 1] = v[a] + rng.standard_normal(16) * 0.05
    v[600] = v[601] = v[0]
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    data += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, cell_rows=128, block_rows=64).collect()}
    assert len(got) == len(data)
    found = sum(got[i].n_links for i in range(900))
    assert 0.97 * g.sum() <= found <= g.sum()
    assert all(got[i].n_links <= g[i].sum() and got[i].kept == (got[i].component_id == i) for i in range(900))
    assert got[601].component_id == 0 and got[600].n_links >= 2
    assert all(got[i].n_links == 0 and got[i].kept for i in range(2000, 2005)) and got[2006].component_id == 2005
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_links_at_the_threshold_survive_many_cells(spark):
    """Pairs of cosine 0.90 to 0.92 over 9 cuts, alone in their neighbourhood: nearly all are linked, from both sides."""
    rng, pairs, dim = np.random.default_rng(12), 600, 64
    a, b = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.92, pairs)[:, None]
    v = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame.repartition(8), cell_rows=4).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * pairs
    assert all(got[i].n_links == got[i + pairs].n_links and (got[i].component_id == got[i + pairs].component_id) == bool(got[i].n_links)
               for i in range(pairs))
    assert all(embeddings.cell_miss(0.9, d, embeddings.cell_window_for(0.9, d, 0.005 / 3, 0.8)) <= 0.005 / 3 for d in (1, 8, 15))


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        s = [prose(rng, 8) + "." for _ in range(6)]
        if bad:
            s[3] = f"you utter {rng.choice(['grubnik', 'florbak', 'zanktor'])} you."
        rows.append((i, " ".join(s), "en", 0.0))
        labels.append((i, int(bad)))
    rows += [(900, None, None, None), (901, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, steps=25)
    got = {r.row.doc_id: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels if (got[i].predicted == 1) != bool(y)]
    assert len(wrong) <= 6 and got[900].score == 0 and got[901].score == 0
    hit = next(i for i, y in labels if y and got[i].predicted)
    text = dict((r[0], r[1]) for r in rows)[hit].encode()
    assert any(b"you utter" in text[s.start:s.end] for s in got[hit].offending)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, lab.limit(0))).where("score > 0").count() == 0


def test_secret_scan_and_redaction(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(60):
        s = f'token = "{hexa(40)}"' if i % 3 == 0 else f"card {rng.randrange(10**15, 10**16)}" if i % 3 == 1 else f"password={hexa(18)}"
        rows.append((i, f"the river {s} made long", None))
    rows += [(70, None, None), (71, "", None), (72, "plain words only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = secrets_scan.scan(docs)
    secret = {r.id for r in found.where("is_secret").collect()}
    assert secret == {i for i in range(60) if i % 3 != 1}
    clean = {r.doc_id: r.text for r in secrets_scan.redact(docs, found).collect()}
    assert clean[0] == 'the river token = "[SECRET]" made long' and clean[1] == rows[1][1] and clean[70] is None and len(clean) == 63
    assert secrets_scan.scan(docs.limit(0)).count() == 0


def test_secrets_of_any_shape_are_candidates(spark):
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    filler = [(i, f'the river token = "{hexa(40)}" made' if i % 2 else f"card {rng.randrange(10**15, 10**16)} long") for i in range(60)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "qRtZ/" * 12 + "\n-----END RSA PRIVATE KEY-----"
    twice = hexa(32)
    texts = {100: ("set password=hunter2! now", "hunter2!"), 101: ("key sk_live_abcdefGHIJKLmnop here", "sk_live_abcdefGHIJKLmnop"),
             102: ("go to postgres://bob:s3c!t@db.host/x now", "s3c!t"), 103: (f"see {pem} end", pem),
             104: ('"api_key": "two words, $x", next', "two words, $x"), 105: (f"aa {twice} then password={twice} end", twice),
             106: ("token xoxb-abcdefghij ok", "xoxb-abcdefghij"), 107: ("pwd: x9.", "x9")}
    docs = spark.createDataFrame(filler + [(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    found = secrets_scan.scan(docs)
    rows = {(r.id, r.candidate): r for r in found.collect()}
    assert {(i, c) for i, (_, c) in texts.items()} <= set(rows)
    assert rows[105, twice].before.endswith("password=") and rows[105, twice].after == " end"
    assert all(rows[i, texts[i][1]].is_secret for i in (101, 102, 103, 105, 106))
    one = spark.createDataFrame([(i, c, True) for i, (_, c) in texts.items()] + [(200, "we", True)], "id long, candidate string, is_secret boolean")
    more = docs.union(spark.createDataFrame([(200, "we were: password=we and we")], docs.schema))
    clean = {r.doc_id: r.text for r in secrets_scan.redact(more, one).collect()}
    assert all(clean[i] == t.replace(c, "[SECRET]") for i, (t, c) in texts.items())
    assert clean[200] == "we were: password=[SECRET] and we"


def test_assigned_values_end_before_closing_punctuation(spark):
    rng = random.Random(12)
    tokens = ["".join(rng.choice("ab1.,;:)]}>\"'") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    tokens = [t for t in tokens if t[0] not in "\"'" and "://" not in t]
    docs = spark.createDataFrame([(i, f"x password={t} y") for i, t in enumerate(tokens)], "doc_id long, text string")
    got = {r["id"]: r["candidate"] for r in secrets_scan.candidates(docs).collect()}
    assert got == {i: t[0] + t[1:].rstrip(".,;:)]}>\"'") for i, t in enumerate(tokens)}


def test_long_runs_of_punctuation_cost_one_pass(spark):
    import time

    docs = spark.createDataFrame([(1, "password=" + ")" * 300_000), (2, "password=" + "a)" * 150_000 + " end")], "doc_id long, text string")
    at = time.time()
    found = {r["id"]: len(r["candidate"]) for r in secrets_scan.candidates(docs).collect()}
    assert found == {1: 1, 2: 299_999} and time.time() - at < 60


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.count()
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert before * 0.7 <= docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
