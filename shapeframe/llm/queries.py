"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmltext, jaccard, linededup, mixing, pii, quality, tokens, urlfilter
from .common import table

#: The vocabulary of op6; its path is a parameter of the operator.
VOCABULARY = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.RULES).drop("listed")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chat.format_chat(table(spark, sf_dir, "conversations"), chat.REPLY, turns_as_calls=True).drop("part", "errors")
    return c.withColumn("linked", F.coalesce("linked", F.lit(False)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op9_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "n_spans", "base_sha256", "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup_documents(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_url_filter, op3_ngram_jaccard, op4_chat_format, op5_decontaminate, op6_count_tokens, op7_html_text, op8_quality_rules, op9_find_pii, op10_line_dedup)}
ORACLE_SQL = {"op1_mix_sources": mixing.ORACLE, "op2_url_filter": urlfilter.ORACLE, "op3_ngram_jaccard": jaccard.ORACLE, "op4_chat_format": chat.ORACLE, "op8_quality_rules": quality.ORACLE, "op10_line_dedup": linededup.ORACLE}
