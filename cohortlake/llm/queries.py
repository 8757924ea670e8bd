"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, language, licenses, mixing, pii, prefixjoin, revisits, suffixes, topk
from ._shared import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolved_pages(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_prefixjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.linked(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_language": op2_language,
    "op3_revisits": op3_revisits,
    "op4_pii": op4_pii,
    "op5_prefixjoin": op5_prefixjoin,
    "op6_chat": op6_chat,
    "op7_topk": op7_topk,
    "op8_suffixes": op8_suffixes,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op3_revisits": revisits.SQL, "op6_chat": chat.SQL, "op7_topk": topk.SQL, "op10_mixing": mixing.SQL}
