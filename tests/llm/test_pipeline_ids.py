"""Null and repeated ids in the near-duplicate stage of the pipeline."""

import corpus_pipeline

from .test_documents import DATA


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, c, "x"), (None, None, "x"), (1, a, "x"), (1, a, "x"), (2, a, "x"), (3, b, "x"), (3, b, "x"), (3, c, "x"), (4, None, "x"), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, c), (None, None), (1, a), (3, b), (3, c), (4, None), (5, "")], key=str)
