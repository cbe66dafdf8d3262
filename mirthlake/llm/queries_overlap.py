"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .overlap import cross_split_overlaps
from .text import WORDS_SQL, table, trim_wide


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    smoke = table(spark, d, "smoke_cases").select("id", "context", "source", F.lower(trim_wide(F.col("split"))).alias("split")).where("split is not null")
    fresh = table(spark, d, "relevance_stage3000_fresh_humour").select("id", "context", "source", F.lit("fresh_humour").alias("split"))
    return smoke.where("split = 'train'"), smoke.where("split <> 'train'").unionByName(fresh)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    train, evaluation = _sides(spark, d)
    pairs = cross_split_overlaps(train, evaluation, "context", "id")
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by evaluation split and source: pairs, evaluation records hit, and all evaluation records."""
    train, evaluation = _sides(spark, d)
    pairs = cross_split_overlaps(train, evaluation, "context", "id")
    per_id = pairs.groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("n"))
    records = evaluation.select("id", "split", F.coalesce("source", F.lit("(none)")).alias("source")).distinct()
    joined = records.join(per_id, "id", "left")
    return joined.groupBy("split", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count("n").alias("n_overlapping"), F.count("*").alias("n_records"))


BASE = f"""
WITH s AS (SELECT DISTINCT id, lower(regexp_replace(split, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')) AS split, source, {WORDS_SQL.format("context")} AS ws FROM smoke_cases WHERE split IS NOT NULL AND context IS NOT NULL),
  e AS (SELECT id, split, source, ws FROM s WHERE split <> 'train' UNION ALL SELECT DISTINCT id, 'fresh_humour', source, {WORDS_SQL.format("context")} FROM relevance_stage3000_fresh_humour WHERE context IS NOT NULL),
  a AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s WHERE split = 'train'), b AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM e),
  p AS (SELECT a.id AS x, b.id AS y FROM a JOIN b USING (w) GROUP BY a.id, b.id HAVING 5 * count(*) >= 3 * (any_value(a.n) + any_value(b.n) - count(*)))"""
FOUND = BASE + "\nSELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM p WHERE x <> y"
REPORT = BASE + """,
  r AS (SELECT DISTINCT id, lower(regexp_replace(split, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS split, coalesce(source, '(none)') AS source FROM smoke_cases WHERE split IS NOT NULL UNION ALL SELECT DISTINCT id, 'fresh_humour', coalesce(source, '(none)') FROM relevance_stage3000_fresh_humour),
  c AS (SELECT y AS id, count(*) AS n FROM p GROUP BY y)
SELECT split, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs, count(n) AS n_overlapping, count(*) AS n_records FROM r LEFT JOIN c USING (id) WHERE split <> 'train' GROUP BY split, source"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {"p1_found": FOUND, "p1_report": REPORT}
