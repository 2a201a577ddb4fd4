"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, chat, collocations, decontaminate, html_text, interaction, line_dedup, minhash, mixture, pii, quality, suffix_array,
    url_filter,
)
from .common import table


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.report(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "documents"))


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array": op1_suffix_array,
        "op8_minhash": op8_minhash,
        "op7_chat": op7_chat,
        "op6_line_dedup": op6_line_dedup,
        "op5_pii": op5_pii,
        "op4_decontaminate": op4_decontaminate,
        "op2_url_filter": op2_url_filter,
        "op3_html_text": op3_html_text,
        "op9_bpe": op9_bpe,
        "op10_quality": op10_quality,
        "op11_collocations": op11_collocations,
        "op12_mixture": op12_mixture,
        "op13_interaction": op13_interaction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.SQL, "op4_decontaminate": decontaminate.SQL, "op7_chat": chat.SQL,
        "op10_quality": quality.SQL, "op11_collocations": collocations.SQL, "op13_interaction": interaction.SQL,
    }
