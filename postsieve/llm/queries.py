"""Queries of the training-text operators, by name: callables (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postsieve.llm import canonical, encoding, language, leakage, neardup, newtext, packing, personal, truncated
from postsieve.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "enron_dataset"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "enron_dataset"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "enron_dataset"), table(spark, d, "arf_result"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.found(table(spark, d, "enron_dataset"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "enron_dataset"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "enron_dataset"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "enron_dataset"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.found(table(spark, d, "documents"))


@query
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncated.shares(table(spark, d, "documents"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_item"))


@query
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(table(spark, d, "documents"), table(spark, d, "pack_capacity"))
