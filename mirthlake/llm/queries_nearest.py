"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nearest import nearest_vectors
from .text import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_vectors(table(spark, d, "stage_3000_local_signals"), "id", "embedding")
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors(table(spark, d, "stage_3000_local_signals"), "id", "embedding")


NEAR = """
WITH v AS (SELECT id, min(CAST(embedding AS DOUBLE[])) AS v FROM stage_3000_local_signals WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
  s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM v a JOIN v b ON a.id <> b.id),
  r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS INT) AS rank FROM s) WHERE rank <= 10)"""

QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest}
SQL = {"p5_found": NEAR + " SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r", "p5_nearest": NEAR + " SELECT id, other, rank, cosine FROM r"}
