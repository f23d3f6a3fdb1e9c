"""The corpus pipeline against a composition of brute-force steps."""

import base64
import hashlib

import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from rigspark.llm import quality_rules, queries

from .test_documents import DATA, brute_classes, brute_hits
from .test_passages import brute_passages


def test_pipeline(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    kept = quality_rules._verdict(quality_rules.counted(pa.array(docs.text)), 0.5)[1]
    rows = [(i, t) for i, t, k in zip(docs.doc_id, docs.text, kept, strict=True) if k]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i][1] == i]
    spans = {i: x[1] for i, x in brute_passages(rows).items()}
    cut = []
    for i, t in rows:
        parts, at = [], 0
        for a, b in spans.get(i, []):
            parts.append(t[at:a])
            at = b
        cut.append((i, "".join([*parts, t[at:]])))
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    hits = brute_hits(cut, zip(bench.item_id, bench.text, strict=True))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest() for i, t in cut if not hits[i][1]}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


ODD = [(None, "no id here", "x", 1), (1, None, "x", None), (2, "", "x", 0), (3, " \n ", "x", 3), (4, "same words in this row " * 30, "x", 1), (4, "same words in this row " * 30, "x", 1), (5, "long " * 300_000, "x", 1), (5, "other text under one id", "x", 1)]


def test_stages_with_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in ODD], "doc_id long, text string, lang string, n_chars long, key int, removed int, first int")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DATA)
        assert {r["doc_id"] for r in rows.collect()} <= {r[0] for r in ODD}
    kept = {name: stage(spark, docs, DATA).count() for name, stage in corpus_pipeline.STAGES}
    assert kept == {"quality rules": 0, "n-gram Jaccard join": 7, "substring dedup": 8, "benchmark decontamination": 8, "byte-level BPE": 8}


def test_a_failing_run_leaves_no_tables(spark, tmp_path):
    import pytest

    with pytest.raises(Exception):
        corpus_pipeline.run(spark, str(tmp_path / "missing"))


def test_near_duplicates_keep_what_overlaps_two_texts_of_one_id(spark):
    a, b = [f"a{k}" for k in range(100)], [f"b{k}" for k in range(100)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join(a[:52] + b[:52]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert sorted(map(tuple, kept.collect())) == sorted(rows)
