"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_sources, shares_reached
from .packing import pack_documents
from .text import table
from .tokens import with_tokens


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = with_tokens(table(spark, d, "documents"), "doc_id", "text", [])
    return pack_documents(sizes, table(spark, d, "container_sizes"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(with_tokens(table(spark, d, "documents"), "doc_id", "text", ["source"]), table(spark, d, "mix_targets"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares_reached(_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p6_containers": p6_containers, "p7_selection": p7_selection, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
