"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .personal import personal_mentions, sanitised
from .text import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_mentions(table(spark, d, "documents"))


def p8_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return sanitised(table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p8_sanitised": p8_sanitised}
SQL: dict[str, str] = {}
