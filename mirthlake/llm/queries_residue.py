"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .residue import template_residue
from .text import table

FIELDS = ["message", "near_miss_context"]


def values(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "catalogue").select("id", *FIELDS, F.col("name").alias("title"), F.col("image_url").alias("address"))
    two = table(spark, d, "stage_300_seed").select("id", *FIELDS, F.col("name").alias("title"), F.coalesce("provenance.source_url", "media.image_url").alias("address"))
    rows = one.unionByName(two)
    return rows.select("id", "title", "address", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("id", "x.field_name", "x.value", "title", "address")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(values(spark, d)).select("id", "field_name")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The fields to be left out, with all the evidence that speaks against each."""
    return template_residue(values(spark, d))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds}
SQL: dict[str, str] = {}
