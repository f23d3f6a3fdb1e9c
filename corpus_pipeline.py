"""The corpus pipeline: raw documents to token digests, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspark.llm.decontamination import decontaminate
from rigspark.llm.ngram_join import ngram_jaccard_join
from rigspark.llm.quality_rules import keep_quality
from rigspark.llm.queries import token_digests
from rigspark.llm.spill import Scratch, sized_batches
from rigspark.llm.substring_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep.

    Texts that are null, empty or without words are rejected.  Null ids and
    repeated rows are judged each by itself; texts of any length are read
    whole; an empty table stays empty and other columns pass unchanged.
    """
    sized_batches(spark)
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Rows without an id are in no class and all stay.  Of rows that repeat both
    the id and the text one stays; different texts under one id all stay, as
    each may be the only one of its kind.  Texts without words are linked with
    nothing and stay; texts of any length are compared whole.
    """
    sized_batches(spark)
    first = ngram_jaccard_join(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    once, more = (docs.join(first.where(n).select("doc_id"), "doc_id", "left_semi") for n in ("n = 1", "n > 1"))
    return once.unionByName(more.dropDuplicates(["doc_id", "text"])).unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the passages and lines that stand earlier in the corpus.

    Rows with a null id or text pass unchanged.  Rows that repeat an id lose
    only what is repeated in their own text and what no other row of the id
    holds first.  ``n_chars`` follows the text; texts of any length are read
    whole.
    """
    sized_batches(spark)
    return drop_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark window.

    Null and empty texts hold none and stay, as do null ids; repeated rows are
    judged each by itself, by the whole text.
    """
    sized_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's token ids and of the bytes they decode to.

    A null text counts as the empty one; null ids and repeated rows keep a row
    each; texts of any length are encoded whole.
    """
    sized_batches(spark)
    return token_digests(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeats), ("benchmark decontamination", benchmark_leaks), ("byte-level BPE", tokens)]

#: The near-duplicate and line-model stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written, the last one's stays for the reader."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.stored(stage(spark, docs, sf_dir), f"stage{k}")
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
