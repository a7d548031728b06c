"""Registered queries of this subpackage: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import (
    bpe_codec, hard_negatives, html_extract, mixing, mpeg_audio, ngram_join, reply_trees, secret_scan, token_counts, token_files, toxicity, vector_codes, vector_topk,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(table(spark, sf_dir, "documents"), digest_only=True)


def op6_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.format_conversations(table(spark, sf_dir, "conversations"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_mix_sources": op4_mix_sources,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_vector_topk": op6_vector_topk,
    "op7_token_counts": op7_token_counts,
    "op8_reply_trees": op8_reply_trees,
    "op9_mpeg_audio": op9_mpeg_audio,
    "op10_secret_scan": op10_secret_scan,
    "op11_html_extract": op11_html_extract,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op6_vector_topk": vector_topk.ORACLE,
    "op8_reply_trees": reply_trees.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
