"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .term_counts import term_frequencies
from .text import one_record, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    seed = one_record(table(spark, d, "stage_300_seed").select("id", "tags", "ingested_at"), "id").select(F.col("tags").alias("terms"))
    gifs = one_record(table(spark, d, "stage_3000_reaction_gif_replacements").select("proposed_id", "categories", "ingested_at"), "proposed_id").select(F.col("categories").alias("terms"))
    return term_frequencies(seed.unionAll(gifs), "terms")


P3 = r"""
WITH r AS (
  SELECT 's' AS t, id, any_value(tags) AS terms FROM stage_300_seed GROUP BY id
  UNION ALL
  SELECT 'g' AS t, proposed_id AS id, any_value(categories) AS terms FROM stage_3000_reaction_gif_replacements GROUP BY proposed_id
), e AS (
  SELECT t, id, regexp_replace(lower(regexp_replace(nfc_normalize(x), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '[\s\x{00A0}_-]+', '-', 'g') AS term
  FROM (SELECT t, id, unnest(terms) AS x FROM r)
), c AS (
  SELECT term, count(*) AS n_uses, count(DISTINCT t || id) AS n_records FROM e WHERE term <> '' GROUP BY term
)
SELECT term, n_uses, n_records,
  CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.05 * (SELECT count(*) FROM r) THEN 'common' ELSE 'useful' END AS mark
FROM c
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3}
