"""Queries that apply each corpus operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .chat_format import chat_digests
from .decontamination import find_contamination
from .fill_in_middle import fill_in_middle_digests
from .lexical_search import ranked_search
from .line_dedup import line_dedup
from .mixing import in_first_use_order, mix_sources
from .ngram_jaccard import ngram_jaccard
from .quality_classifier import score_quality
from .quality_rules import quality_rules
from .secret_scan import secret_digests
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), with_bytes=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), with_text=False, whole=True)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(turns.unionByName(more))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_first_use_order(mix_sources(_table(spark, sf_dir, "documents")))
    return mixed.withColumn("position", F.round("position", 6))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracle.NGRAM_JACCARD,
    "op2_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op3_decontamination": oracle.DECONTAMINATION,
    "op4_secret_scan": oracle.SECRET_SCAN,
    "op5_quality_rules": oracle.QUALITY_RULES,
    "op6_line_dedup": oracle.LINE_DEDUP,
    "op7_chat_format": oracle.CHAT_FORMAT,
    "op8_mixing": oracle.MIXING,
    "op10_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op11_fill_in_middle": oracle.FILL_IN_MIDDLE,
    "op12_lexical_search": oracle.LEXICAL_SEARCH,
}
