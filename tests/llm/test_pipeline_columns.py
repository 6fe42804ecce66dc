"""The near-duplicate stage of the pipeline with columns that carry its own names."""

import corpus_pipeline


def test_near_duplicate_stage_with_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words, "a", 9, 8), (2, words, "b", 9, 8), (3, words + " end", "c", 9, 8), (4, other, "d", 9, 8),
            (5, "same id", "e", 9, 8), (5, "same id", "e", 9, 8), (6, None, "f", 9, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g_id string, g_hash long, t_id long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["g_id"], r["t_id"]) for r in kept.collect()) == [(1, "a", 8), (4, "d", 8), (5, "e", 8), (6, "f", 8)]
