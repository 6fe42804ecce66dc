"""Registered queries of the training-data operators: name -> (spark, sf_dir) job, and DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airmetrics.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer())


@query
def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from airmetrics.llm.tokenfile import read_tokens, write_tokens
    from airmetrics.session import scratch_path

    path = f"{scratch_path(spark, 'llm')}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, _tokenizer())
    return read_tokens(spark, path)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from airmetrics.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from airmetrics.llm.warc import page_rows, read_warc, write_warc
    from airmetrics.session import scratch_path

    path = f"{scratch_path(spark, 'llm')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_rows(read_warc(spark, path, with_payload=False))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.suffix_merge import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.secrets_scan import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from airmetrics.llm.hard_negatives import mine, relabelled

    return mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op13_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM terms t JOIN kept k USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS lp
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, ((p - lp) * (p - lp) // lp)::BIGINT,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY (p - lp) * (p - lp) // lp DESC, term) AS INTEGER) AS rank
FROM shares WHERE n > 0 AND p > lp QUALIFY rank <= 200
"""


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airmetrics.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("lang", "class_distance", "word_distance")


ORACLES["op11_quality_rules"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS lw FROM docs),
win AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, sum(least(8, step)) AS n FROM (SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8) AS step FROM rep) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, length(text) AS n, length(regexp_replace(text, '[a-z]', '', 'g')) AS small, length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
             length(regexp_replace(text, '[0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS blanks,
             length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS wide FROM docs),
base AS (
  SELECT w.r, doc_id, lang, len(ws) AS n_words, c.blanks AS word_chars, c.n - c.symbols AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(ws) AS base_failed
  FROM w JOIN c USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT DISTINCT r, lang, unnest(lw) AS word FROM w) GROUP BY ALL),
common AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k
           FROM df JOIN (SELECT lang, count(*) AS n_docs FROM docs GROUP BY lang) USING (lang) WHERE n >= n_docs * 0.05 QUALIFY k <= 40),
bins AS (
  SELECT r, lang, 'words' AS kind, coalesce(k, 0) AS k, count(*) AS n
  FROM (SELECT r, lang, unnest(lw) AS word FROM w) LEFT JOIN common USING (lang, word) GROUP BY ALL
  UNION ALL
  SELECT r, lang, 'classes', unnest([1, 2, 3, 4, 5, 6, 7]),
         unnest([n - small, n - capitals, n - digits, n - blanks, n - symbols, n - wide, small + capitals + digits + blanks + symbols + wide - 5 * n])
  FROM c JOIN docs USING (r)),
used AS (SELECT r, lang, n_words FROM base WHERE NOT base_failed AND n_words >= 50),
refs AS (SELECT lang FROM used GROUP BY lang HAVING sum(n_words) >= 5000),
shares AS (SELECT lang, kind, k, n / sum(n) OVER (PARTITION BY lang, kind) AS q
           FROM (SELECT b.lang, kind, k, sum(n) AS n FROM bins b JOIN used USING (r) WHERE b.lang IN (FROM refs) GROUP BY ALL)),
js AS (
  SELECT r, kind, round(sqrt(greatest(0.5 + sum((p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END - q) / 2), 0)), 6) AS d
  FROM (SELECT b.r, b.kind, n / sum(n) OVER (PARTITION BY b.r, b.kind) AS p, coalesce(s.q, 0) AS q
        FROM bins b LEFT JOIN shares s ON s.lang = b.lang AND s.kind = b.kind AND s.k = b.k WHERE n > 0) GROUP BY r, kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (n_words < 50 OR lang NOT IN (FROM refs) OR (a.d <= 0.25 AND b.d <= 0.37)) AS kept
FROM base LEFT JOIN js a ON a.r = base.r AND a.kind = 'classes' LEFT JOIN js b ON b.r = base.r AND b.kind = 'words'
"""
