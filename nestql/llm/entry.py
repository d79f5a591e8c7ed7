"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nestql.llm import decontaminate, jaccard, langid, lines, media, mixing, pages, pii, suffixes, tokens
from nestql.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_of_documents(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens_of_documents(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(table(spark, sf_dir, "documents"))


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages_digest(table(spark, sf_dir, "pages"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substrings_digest(table(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of_documents(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_media": op1_media,
        "op2_mix": op2_mix,
        "op3_tokens": op3_tokens,
        "op4_language": op4_language,
        "op5_pages": op5_pages,
        "op6_substrings": op6_substrings,
        "op7_leaks": op7_leaks,
        "op8_jaccard": op8_jaccard,
        "op9_lines": op9_lines,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {}
