"""Queries: search pages, requests, reviews, replays and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators.retrieval import top_k
from .common import LINES_SQL, lines, once, r6, t


def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    """Replacements whose record, nested parts included, has a text; by provider and kind of evidence."""
    r = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "name", "provider", "categories", "usage_evidence", "assistive_text")
    hit = F.contains(F.lower(F.to_json(F.struct("name", "categories", "usage_evidence.kind", "usage_evidence.dataset", "assistive_text"))), F.lit("sleepy"))
    return r.where(hit).groupBy("provider", F.col("usage_evidence.kind").alias("kind")).agg(F.count("*").alias("n"))


FACETED_SQL = "SELECT provider, usage_evidence.kind AS kind, count(*) AS n FROM (SELECT DISTINCT ON (proposed_id) * FROM stage_3000_reaction_gif_replacements) WHERE contains(lower(concat_ws('|', name, array_to_string(categories, '|'), usage_evidence.kind, usage_evidence.dataset, assistive_text)), 'sleepy') GROUP BY ALL"


def representations(spark: SparkSession, d: str) -> DataFrame:
    """Live records with an image in both representations: the name alone, or all texts with what to avoid; in slices of the catalogue."""
    c = once(spark, d, "catalogue", "id", "name", "message", "relational_pattern", "example_context", "near_miss_context", "image_url", "availability")
    c = c.withColumn("first", F.substring("id", 5, 1) < "4")
    live = c.where("image_url is not null and coalesce(availability, 'live') = 'live'")
    minimal = F.length(F.concat_ws("|", "id", "name"))
    enriched = F.length(F.concat_ws("|", "id", "name", "message", "relational_pattern", "example_context", F.col("near_miss_context").alias("avoid")))
    return live.groupBy("first").agg(F.count("*").alias("n"), F.sum(minimal).alias("minimal_chars"), F.sum(enriched).alias("enriched_chars"), F.max(enriched).cast("bigint").alias("longest"))


REPRESENTATION_SQL = """
SELECT substr(id, 5, 1) < '4' AS first, count(*) AS n, CAST(sum(length(concat_ws('|', id, name))) AS BIGINT) AS minimal_chars, CAST(sum(length(concat_ws('|', id, name, message, relational_pattern, example_context, near_miss_context))) AS BIGINT) AS enriched_chars,
  max(length(concat_ws('|', id, name, message, relational_pattern, example_context, near_miss_context))) AS longest
FROM (SELECT DISTINCT ON (id) * FROM catalogue) WHERE image_url IS NOT NULL AND coalesce(availability, 'live') = 'live' GROUP BY ALL"""


def request_rules(spark: SparkSession, d: str) -> DataFrame:
    """Requests that break a rule of form, by rule; missing choices take their defaults first."""
    s = once(spark, d, "smoke_cases", "id", "title", "context", "category", "split")
    s = s.withColumn("text", F.trim(F.coalesce("context", F.lit("")))).withColumn("scope", F.coalesce("category", F.lit("reactions")))
    rules = [Q.Rule("text_is_given", F.length("text") > 0), Q.Rule("text_is_short", F.length("text") <= 250), Q.Rule("title_is_given", F.length(F.trim("title")) > 0), Q.Rule("scope_is_plain", F.col("scope").rlike("^[a-z-]+$")), Q.Rule("text_is_unique", Q.unique(F.nullif(F.col("text"), F.lit(""))))]
    return Q.violations(s, "id", rules).groupBy("rule").agg(F.count("*").alias("n"))


REQUEST_SQL = """
WITH s AS (SELECT *, trim(coalesce(context, '')) AS text, coalesce(category, 'reactions') AS scope FROM (SELECT DISTINCT ON (id) * FROM smoke_cases)), u AS (SELECT *, count(*) OVER (PARTITION BY text) AS same FROM s),
  v AS (SELECT 'text_is_given' AS rule FROM u WHERE text = '' UNION ALL SELECT 'text_is_short' FROM u WHERE length(text) > 250 UNION ALL SELECT 'title_is_given' FROM u WHERE NOT coalesce(length(trim(title)) > 0, FALSE)
    UNION ALL SELECT 'scope_is_plain' FROM u WHERE NOT regexp_matches(scope, '^[a-z-]+$') UNION ALL SELECT 'text_is_unique' FROM u WHERE text <> '' AND same > 1)
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def reviewer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two reviewers of a case and candidate, and how often they agree: lines of an order and part as reviews by supplier."""
    v = t(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("reviewer")).agg(F.max("l_quantity").alias("q")).withColumn("verdict", F.col("q") >= 25)
    a, b = v.select("l_partkey", F.col("reviewer").alias("ra"), F.col("verdict").alias("va")), v.select("l_partkey", F.col("reviewer").alias("rb"), F.col("verdict").alias("vb"))
    p = a.join(b, "l_partkey").where("ra < rb")
    return p.groupBy((F.col("l_partkey") % 50).alias("shelf")).agg(F.count("*").alias("n_pairs"), N.rounded(M.rate(F.col("va") == F.col("vb"))).alias("agreement"))


PAIR_SQL = f"""
WITH v AS (SELECT l_partkey, l_suppkey AS reviewer, max(l_quantity) >= 25 AS verdict FROM lineitem GROUP BY 1, 2)
SELECT a.l_partkey % 50 AS shelf, count(*) AS n_pairs, {r6("CAST(count(*) FILTER (WHERE a.verdict = b.verdict) AS DOUBLE) / count(*)")} AS agreement FROM v a JOIN v b ON a.l_partkey = b.l_partkey AND a.reviewer < b.reviewer GROUP BY 1"""


def replay_error(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a first and a second run of the same case and candidate, joined: mean and greatest difference."""
    x = lines(spark, d).select("l_orderkey", "id", "l_shipdate", "l_discount")
    first = x.select("l_orderkey", "id", (F.col("l_discount") * 1000).alias("s0"))
    second = x.select("l_orderkey", "id", (F.col("l_discount") * 1000 + F.col("id") % 7 - 3).alias("s1"))
    both = first.join(second, ["l_orderkey", "id"])
    return both.groupBy((F.col("l_orderkey") % 10).alias("arm")).agg(F.count("*").alias("n"), N.rounded(F.avg(F.abs(F.col("s0") - F.col("s1")))).alias("replay_mae"), N.rounded(F.max(F.abs(F.col("s0") - F.col("s1")))).alias("worst"))


REPLAY_SQL = f"SELECT l_orderkey % 10 AS arm, count(*) AS n, {r6('avg(abs(l_discount * 1000 - (l_discount * 1000 + id % 7 - 3)))')} AS replay_mae, {r6('max(abs(l_discount * 1000 - (l_discount * 1000 + id % 7 - 3)))')} AS worst FROM {LINES_SQL} GROUP BY 1"


def lens_triples(spark: SparkSession, d: str) -> DataFrame:
    """For each case the best total over different candidates for three lenses, and how many such triples there are.

    The best triple is among the three best candidates of each lens (two others can take two of them at most), so
    nine rows a case are joined, whatever its number of candidates.
    """
    x = lines(spark, d).select("l_orderkey", "id", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12.5).alias("c"))
    n = x.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 3")
    best = {c: top_k(x, ["l_orderkey"], 3, F.desc(c), F.col("id")) for c in "abc"}
    p, q, r = [best[c].select("l_orderkey", F.col("id").alias(i), c) for c, i in zip("abc", "xyz")]
    all_ = p.join(q, "l_orderkey").where("x <> y").join(r, "l_orderkey").where("x <> z and y <> z")
    top = all_.groupBy("l_orderkey").agg(N.rounded(F.max(F.col("a") + F.col("b") + F.col("c"))).alias("best"))
    return top.join(n, "l_orderkey").select("l_orderkey", "best", (F.col("n") * (F.col("n") - 1) * (F.col("n") - 2)).alias("n_triples"))


TRIPLE_SQL = f"""
WITH x AS (SELECT l_orderkey, id, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12.5::DOUBLE AS c FROM {LINES_SQL})
SELECT p.l_orderkey, {r6("max(p.a + q.b + r.c)")} AS best, count(*) AS n_triples FROM x p JOIN x q ON p.l_orderkey = q.l_orderkey AND p.id <> q.id JOIN x r ON r.l_orderkey = p.l_orderkey AND r.id <> p.id AND r.id <> q.id GROUP BY p.l_orderkey"""


def reveal_gate(spark: SparkSession, d: str) -> DataFrame:
    """Experiments that may be revealed: no successful arm is without a review."""
    e = t(spark, d, "events")
    arms = e.where("event_type in ('view', 'click') and value > 5").select("user_id", "event_type").distinct()
    reviewed = e.where("event_type in ('view', 'click') and value > 30").select("user_id", "event_type").distinct()
    waiting = arms.join(reviewed, ["user_id", "event_type"], "left_anti").select("user_id").distinct()
    return arms.select("user_id").distinct().join(waiting.withColumn("w", F.lit(True)), "user_id", "left").groupBy(F.col("w").isNull().alias("revealed")).agg(F.count("*").alias("n"))


REVEAL_SQL = """
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND value > 5), r AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND value > 30),
  w AS (SELECT user_id, bool_and((user_id, event_type) IN (SELECT (user_id, event_type) FROM r)) AS revealed FROM a GROUP BY user_id)
SELECT revealed, count(*) AS n FROM w GROUP BY revealed"""


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Per stage: records wanted, there, with text, still missing, percent done."""
    done = once(spark, d, "catalogue", "id", "message").agg(F.count("*").alias("n"), F.count("message").alias("ready"))
    stages = spark.createDataFrame([("stage-30", 30), ("stage-300", 300), ("stage-1000", 1000), ("stage-3000", 3000)], "stage string, target int")
    x = stages.join(F.broadcast(done))
    return x.select("stage", "target", F.least("n", "target").cast("bigint").alias("there"), F.greatest(F.lit(0), F.col("target") - F.col("n")).cast("bigint").alias("missing"), F.least(F.lit(100), F.floor(F.col("ready") * 100 / F.col("target"))).cast("bigint").alias("percent"))


PROGRESS_SQL = """
WITH c AS (SELECT count(*) AS n, count(message) AS ready FROM (SELECT DISTINCT id, message FROM catalogue)), s(stage, target) AS (VALUES ('stage-30', 30), ('stage-300', 300), ('stage-1000', 1000), ('stage-3000', 3000))
SELECT stage, target, CAST(least(n, target) AS BIGINT) AS there, CAST(greatest(0, target - n) AS BIGINT) AS missing, CAST(least(100, floor(ready * 100 / target)) AS BIGINT) AS percent FROM s, c"""


def set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Ids in one table, the other, or both; and rows that differ as bags in either direction."""
    a = once(spark, d, "stage_3000_local_signals", "id", "scope").select("id", "scope")
    b = once(spark, d, "catalogue", "id").select("id")
    ids = a.select("id")
    both = ids.intersect(b).agg(F.lit("in_both").alias("what"), F.count("*").alias("n"))
    left = ids.exceptAll(b).agg(F.lit("signals_only").alias("what"), F.count("*").alias("n"))
    right = b.exceptAll(ids).agg(F.lit("catalogue_only").alias("what"), F.count("*").alias("n"))
    overlap = a.where("scope = 'target'").select("id").intersect(b).agg(F.lit("targets_in_catalogue").alias("what"), F.count("*").alias("n"))
    return both.unionByName(left).unionByName(right).unionByName(overlap)


SET_SQL = """
WITH a AS (SELECT DISTINCT id, scope FROM stage_3000_local_signals), b AS (SELECT DISTINCT id FROM catalogue)
SELECT 'in_both' AS what, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'signals_only', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
UNION ALL SELECT 'catalogue_only', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'targets_in_catalogue', count(*) FROM (SELECT id FROM a WHERE scope = 'target' INTERSECT SELECT id FROM b)"""


def case_rules(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases: length, uniqueness, known and distinct targets, labels that agree, by rule."""
    e = once(spark, d, "relevance_stage3000_fresh_humour", "id", "context", "intent_label", "primary_target_id", "acceptable_ids", "failure_modes", "review_status")
    known = t(spark, d, "catalogue").select(F.col("id").alias("a")).unionAll(t(spark, d, "canonical_memes").select("id")).distinct()
    ids = e.select("id", F.explode("acceptable_ids").alias("a"))
    rules = [Q.Rule("id_has_prefix", F.startswith("id", F.lit("eval-"))), Q.Rule("context_is_unique", Q.unique(F.trim(F.lower("context")))), Q.Rule("targets_are_distinct", F.size("acceptable_ids") == F.size(F.array_distinct("acceptable_ids"))), Q.Rule("target_is_acceptable", F.array_contains("acceptable_ids", F.col("primary_target_id"))), Q.Rule("humour_has_targets", (F.col("intent_label") != "humour") | (F.size("acceptable_ids") > 0)), Q.Rule("has_failure_mode", F.size("failure_modes") >= 1), Q.Rule("is_reviewed", F.col("review_status").isNotNull())]
    unknown = ids.join(known, "a", "left_anti").select("id").distinct().select(F.col("id").alias("row_id"), F.lit("targets_are_known").alias("rule"))
    return Q.violations(e, "id", rules).unionByName(unknown).groupBy("rule").agg(F.count("*").alias("n"))


CASE_SQL = """
WITH e AS (SELECT *, count(*) OVER (PARTITION BY trim(lower(context))) AS same FROM (SELECT DISTINCT ON (id) * FROM relevance_stage3000_fresh_humour)), k AS (SELECT id FROM catalogue UNION SELECT id FROM canonical_memes),
  v AS (SELECT 'id_has_prefix' AS rule FROM e WHERE NOT starts_with(id, 'eval-') UNION ALL SELECT 'context_is_unique' FROM e WHERE context IS NOT NULL AND same > 1 UNION ALL SELECT 'targets_are_distinct' FROM e WHERE NOT coalesce(len(acceptable_ids) = len(list_distinct(acceptable_ids)), FALSE)
    UNION ALL SELECT 'target_is_acceptable' FROM e WHERE NOT coalesce(list_contains(acceptable_ids, primary_target_id), FALSE) UNION ALL SELECT 'humour_has_targets' FROM e WHERE NOT coalesce(intent_label <> 'humour' OR len(acceptable_ids) > 0, FALSE)
    UNION ALL SELECT 'has_failure_mode' FROM e WHERE NOT coalesce(len(failure_modes) >= 1, FALSE) UNION ALL SELECT 'is_reviewed' FROM e WHERE review_status IS NULL
    UNION ALL SELECT 'targets_are_known' FROM (SELECT DISTINCT id FROM (SELECT id, unnest(acceptable_ids) AS a FROM e) WHERE a NOT IN (SELECT id FROM k)))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def seeded_arms(spark: SparkSession, d: str) -> DataFrame:
    """Two arms for each order, their order by the seed's parity, each arm with a seed of its own; and the next one to review."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    arms = o.select("o_orderkey", "o_custkey", "o_orderstatus", F.posexplode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("minimal"), F.lit("enriched"))).otherwise(F.array(F.lit("enriched"), F.lit("minimal")))).alias("i", "arm"))
    arms = arms.withColumn("seed", F.pmod(F.col("o_orderkey") * 7919 + 2 * F.col("i"), F.lit(1 << 31).cast("bigint")))
    return arms.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("next_open"), F.sum("seed").alias("seeds"), F.count_if((F.col("i") == 0) & (F.col("arm") == "minimal")).alias("n_minimal_first"))


ARMS_SQL = """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, i, CASE WHEN (o_orderkey + i) % 2 = 0 THEN 'minimal' ELSE 'enriched' END AS arm, (o_orderkey * 7919 + 2 * i) % 2147483648 AS seed FROM orders, (VALUES (0), (1)) v(i))
SELECT o_custkey, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS next_open, CAST(sum(seed) AS BIGINT) AS seeds, count(*) FILTER (WHERE i = 0 AND arm = 'minimal') AS n_minimal_first FROM a GROUP BY o_custkey"""


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Fixed buckets of confidence, the empty ones too, per supplier nation."""
    x = lines(spark, d).join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select("s_nationkey", (F.col("l_quantity") / 50).alias("s"))
    return x.groupBy("s_nationkey").agg(*[F.count_if((F.col("s") >= lo) & (F.col("s") < hi)).alias(name) for name, lo, hi in (("low", 0.0, 0.6), ("medium", 0.6, 0.75), ("high", 0.75, 0.9), ("certain", 0.9, 1.5), ("none", 1.5, 9.0))])


HISTOGRAM_SQL = "SELECT s_nationkey, count(*) FILTER (WHERE s < 0.6::DOUBLE) AS low, count(*) FILTER (WHERE s >= 0.6::DOUBLE AND s < 0.75::DOUBLE) AS medium, count(*) FILTER (WHERE s >= 0.75::DOUBLE AND s < 0.9::DOUBLE) AS high, count(*) FILTER (WHERE s >= 0.9::DOUBLE AND s < 1.5) AS certain, count(*) FILTER (WHERE s >= 1.5) AS none FROM (SELECT s_nationkey, l_quantity / 50 AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY s_nationkey"

QUERIES = {f.__name__: f for f in (faceted_search, representations, request_rules, reviewer_pairs, replay_error, lens_triples, reveal_gate, progress, set_checks, case_rules, seeded_arms, confidence_histogram)}
SQL = {"faceted_search": FACETED_SQL, "representations": REPRESENTATION_SQL, "request_rules": REQUEST_SQL, "reviewer_pairs": PAIR_SQL, "replay_error": REPLAY_SQL, "lens_triples": TRIPLE_SQL, "reveal_gate": REVEAL_SQL, "progress": PROGRESS_SQL, "set_checks": SET_SQL, "case_rules": CASE_SQL, "seeded_arms": ARMS_SQL, "confidence_histogram": HISTOGRAM_SQL}
