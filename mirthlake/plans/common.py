"""What the named queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def once(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """Redelivered rows as one record, with the columns asked for only."""
    return latest(t(spark, d, name).select(key, *columns, "ingested_at"), [key], "ingested_at", key).drop("ingested_at")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def r6(expression: str) -> str:
    return f"(floor(({expression}) * 1e6 + 0.5) / 1e6)"


def big(c: str):
    return F.col(c).cast("bigint")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with an id that is unique; line numbers repeat within an order."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return t(spark, d, "lineitem").withColumn("id", ((F.col("l_linenumber") * F.lit(10_000_000).cast("bigint") + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100_000 + day)


LINES_SQL = "(SELECT *, ((l_linenumber * 10000000::BIGINT + l_partkey) * 100000 + l_suppkey) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS id FROM lineitem)"
