"""Registered queries of the corpus operators: each applies one of them to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.llm import bpe, divergence, html_blocks, language, linededup, mixing, ngram_lm, prefixtrie, quality, secretscan, simhash, spotsigs, topk
from tiepoint.llm.common import read_table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the lines that it loses, and a digest of the text that is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = linededup.dedup_lines(docs)
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return left.select("doc_id", lines.cast("long").alias("lines_left"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = mixing.size_of(F.col("text"))
    return mixing.mix(docs).select("doc_id", size.alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("mix.copies") * size).alias("taken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(read_table(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(read_table(spark, sf_dir, "documents"))


QUERIES = (op1_spotsigs, op2_lm_score, op3_line_dedup, op4_language_id, op5_simhash, op6_topk, op7_html, op8_bpe, op9_mixing, op10_quality, op11_divergence, op12_prefix_trie, op13_secrets)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op1_spotsigs": spotsigs.edited_likeness_sql(), "op9_mixing": mixing.mix_sql(), "op6_topk": topk.top_k_sql(), "op11_divergence": divergence.audit_sql(), "op12_prefix_trie": prefixtrie.nodes_sql(), "op13_secrets": secretscan.report_sql()}
