"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontamination, fuzzy_lines, html_text, mixing, near_duplicates, quality, secrets, spelling, substrings, token_alignment, token_counts

#: The driver alone reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.counted(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.grouped(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.curve(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.scored(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


_ALL = (op1_chat_format, op2_quality_rules, op3_line_dedup, op4_near_duplicates, op5_mixing, op6_token_counts, op7_decontamination, op8_secret_scan, op9_repeated_substrings, op10_html_extraction, op11_token_alignment, op12_byte_bpe, op13_spelling_variants)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_chat_format": chat.ORACLE, "op4_near_duplicates": near_duplicates.ORACLE, "op2_quality_rules": quality.oracle(), "op5_mixing": mixing.oracle(), "op13_spelling_variants": spelling.ORACLE}
