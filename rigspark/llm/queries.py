"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .byte_bpe import bpe_encode
from .chat_format import canonical_turns, format_chats, read_back
from .cross_tokenizer import align_tokenizers
from .decontamination import find_contamination, hit_words
from .hard_negatives import mine_hard_negatives
from .html_extract import extract_main_text
from .ngram_join import ngram_jaccard_join
from .packing import pack_tokens
from .personal_data import KINDS, find_personal_data, span_text
from .quality_classifier import score_quality, train_quality
from .quality_rules import quality_rules
from .spill import sized_batches
from .substring_dedup import repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sized_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Round trip of every text through the vocabulary, as digests."""
    both = bpe_encode(docs, vocabulary(), public_tokenizers.PATTERN, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


_SAID = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = F.to_json(F.struct(F.array(*(F.struct(F.lit(role).alias("role"), F.lit(_SAID).alias("content")) for role in ("user", "assistant"))).alias("messages")))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), said.alias("record"))
    back = read_back(format_chats(canonical_turns(rows.unionByName(extra))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


_SLASH = r"regexp_replace({0}, '([<\[])(\\*)(\||/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g')"
OP3_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role || chr(10) || text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_SLASH.format('role')}) + length({_SLASH.format('text')}) + 13)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.col("longest.words").alias("longest_words"), F.col("longest.at").alias("longest_at"), F.col("longest.item").alias("longest_item"), F.col("longest.item_at").alias("longest_item_at"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose repeated passages or lines, and their places in the original text."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), added)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH given AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor, a.label AS own, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor, own, id AS positive, score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.positive AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> p.own AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_byte_bpe, op3_chat_format, op4_quality_classifier, op5_token_packing, op6_html_extract, op7_decontamination, op8_url_filter, op9_substring_dedup, op10_quality_rules, op11_cross_tokenizer, op12_personal_data, op13_hard_negatives)}
ORACLES = {"op3_chat_format": OP3_SQL, "op8_url_filter": url_filter.ORACLE, "op13_hard_negatives": OP13_SQL}
