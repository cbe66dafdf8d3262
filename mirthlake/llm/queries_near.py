"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .text import WORDS_SQL, table

TEXTS = ["message", "relational_pattern", "example_context"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "catalogue"), "id", TEXTS)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(table(spark, d, "catalogue"), "id", TEXTS, threshold=(3, 5))


FOUND = f"""
WITH s AS (SELECT DISTINCT id, {WORDS_SQL.format("concat_ws(' ', coalesce(message, ''), coalesce(relational_pattern, ''), coalesce(example_context, ''))")} AS ws FROM catalogue),
  a AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s)
SELECT x.id AS id_a, y.id AS id_b FROM a x JOIN a y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id HAVING 5 * count(*) >= 3 * (any_value(x.n) + any_value(y.n) - count(*))"""

GROUPS = f"""
WITH RECURSIVE s AS (SELECT DISTINCT id, list_sort({WORDS_SQL.format("concat_ws(' ', coalesce(message, ''), coalesce(relational_pattern, ''), coalesce(example_context, ''))")}) AS ws FROM catalogue),
  a AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s),
  p AS (SELECT x.id AS u, y.id AS v FROM a x JOIN a y ON x.w = y.w AND x.id <> y.id GROUP BY x.id, y.id HAVING 5 * count(*) >= 3 * (any_value(x.n) + any_value(y.n) - count(*))),
  r AS (SELECT u AS id, v AS root FROM p UNION SELECT r.id, p.v FROM r JOIN p ON r.root = p.u),
  g AS (SELECT id, min(root) AS root FROM r GROUP BY id),
  l AS (SELECT p.u AS id, count(DISTINCT y.ws) AS n FROM p JOIN s x ON x.id = p.u JOIN s y ON y.id = p.v WHERE x.ws <> y.ws GROUP BY p.u)
SELECT s.id, least(s.id, coalesce(g.root, s.id)) AS group_id, CASE WHEN len(ws) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY ws) END AS n_copies, coalesce(l.n, 0) AS n_links FROM s LEFT JOIN g USING (id) LEFT JOIN l USING (id)"""

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL = {"p2_found": FOUND, "p2_groups": GROUPS}
