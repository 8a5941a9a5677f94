"""Queries of the training-data operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import (audit, brown, chat, collocations, fingerprints, jaccard, linededup, mixing, packing, quality, secrets,
                          substrings, urlfilter)
from sitewise.llm.oracles import ORACLES

RULES = [urlfilter.Rule("com/en/", "block"), urlfilter.Rule("example.com/en/7", "allow"),
         urlfilter.Rule("net/de/", "allow"), urlfilter.Rule("example.net/de/8", "block"),
         urlfilter.Rule("org/es/", "block")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(table(spark, folder, "documents"))
    return judged.select("doc_id", *[f"__quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_bad_lines", "n_kept_words")])


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("__lines.n_lines").cast("bigint").alias("n_lines"),
                       F.col("__lines.n_removed").cast("bigint").alias("n_removed"),
                       F.sha2("__lines.kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.robustness(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urlfilter.judge(pages, RULES, urlfilter.reported(pages)).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score(table(spark, folder, "documents"))


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.components(table(spark, folder, "documents"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    marked = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chat.digest(chat.format_conversations(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_best_fit_packing, op3_line_dedup, op4_fingerprints, op5_url_filter,
        op6_suffix_array_dedup, op7_class_lm, op8_ngram_jaccard, op9_mix_sources, op10_secret_scan, op11_filter_audit,
        op12_phrase_mining, op13_chat_format)}
