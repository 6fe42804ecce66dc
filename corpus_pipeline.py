"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``. SQL cannot express the trained stages, so ``ORACLE_SQL`` is None; the tests
check the stages by behaviour on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm import decontaminate, jaccard, packing, secrets_scan, toxicity
from airmetrics.llm.common import stored, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates the document with the smallest id stays."""
    found = stored(jaccard.jaccard_join(docs).select("doc_id", "text_hash", "kept"), "kept-documents")
    gone = found.where("not kept").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # the dropped rows are the smaller side: one join on (id, text hash), then copies of one and the same row
    left = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["g_id"]) & (F.xxhash64(text) == gone["g_hash"]), "left_anti")
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("t_id"))
    twice = stored(twice, "repeated-ids")
    if not twice.take(1):
        return left
    return left.join(twice, left["doc_id"] == twice["t_id"], "left_anti").unionByName(
        left.join(twice, left["doc_id"] == twice["t_id"], "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the benchmark contaminates go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: findings that the forest confirms are replaced in the text; every document stays."""
    clean = secrets_scan.redact(docs, secrets_scan.scan(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of all remaining documents."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}-{name}")
    return docs
