"""Queries: rule sets of candidates and of model answers, safety rates, arms ranked, first ranks and round trips of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as T
from ..operators import answers as V
from ..operators import catalogue as C
from ..operators import graph
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import similarity as S
from ..operators.retrieval import top_k
from .catalogue import HAMMING_SQL, NAME_SQL, image_signs
from .common import LINES_SQL, lines, once, r6, sql_text, t
from .retrieval import RECOMMEND_SQL, VIEWS, _fuse_sql, _vectors, _view_sql, recommend_batch

SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def _https(c: str):
    return F.startswith(F.lower(c), F.lit("https://"))


def candidate_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of replacement candidates: form of ids, media, evidence, state, and uniqueness within and against known names."""
    r = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "name", "source_url", "categories", "assistive_text", "media_type", "media_url", "preview_url", "mime_type", "review_status", "human_validated", "usage_evidence")
    r = r.withColumn("key", T.simple_name(F.col("name")))
    used = F.col("usage_evidence.kind") == "observed_reaction_usage"
    rules = [
        Q.Rule("id_is_slug", F.col("proposed_id").rlike(SLUG)),
        Q.Rule("id_says_gif", F.startswith("proposed_id", F.lit("gif-"))),
        Q.Rule("name_is_given", F.col("key") != ""),
        Q.Rule("name_is_unique", Q.unique("key")),
        Q.Rule("source_is_https", _https("source_url")),
        Q.Rule("media_is_gif", (F.col("media_type") == "gif") & (F.col("mime_type") == "image/gif")),
        Q.Rule("media_is_https", _https("media_url") & _https("preview_url")),
        Q.Rule("media_is_unique", Q.unique("media_url")),
        Q.Rule("has_categories", (F.size("categories") >= 1) & ~F.exists("categories", lambda x: x.isNull() | (F.trim(x) == ""))),
        Q.Rule("has_description", F.length(F.trim("assistive_text")) > 0),
        Q.Rule("text_is_safe", ~F.coalesce(F.col("assistive_text").rlike(P.UNSAFE), F.lit(False))),
        Q.Rule("is_not_validated", ~F.col("human_validated")),
        Q.Rule("has_evidence", F.col("usage_evidence.kind").isNotNull()),
        Q.Rule("usage_is_counted", ~used | (F.col("usage_evidence.conversation_uses") >= 1)),
    ]
    known = once(spark, d, "catalogue", "id", "name").select(T.simple_name(F.col("name")).alias("key")).where("key <> ''").distinct()
    clash = r.join(known, "key", "left_semi").select(F.col("proposed_id").alias("row_id"), F.lit("name_is_new").alias("rule"))
    return Q.violations(r, "proposed_id", rules).unionByName(clash).groupBy("rule").agg(F.count("*").alias("n"))


_RULES = {
    "id_is_slug": f"regexp_matches(proposed_id, '{SLUG}')",
    "id_says_gif": "starts_with(proposed_id, 'gif-')",
    "name_is_given": "key <> ''",
    "source_is_https": "starts_with(lower(source_url), 'https://')",
    "media_is_gif": "media_type = 'gif' AND mime_type = 'image/gif'",
    "media_is_https": "starts_with(lower(media_url), 'https://') AND starts_with(lower(preview_url), 'https://')",
    "has_categories": "len(categories) >= 1 AND len(list_filter(categories, lambda x: x IS NULL OR trim(x) = '')) = 0",
    "has_description": "length(trim(assistive_text)) > 0",
    "text_is_safe": f"NOT coalesce(regexp_matches(assistive_text, {sql_text(P.UNSAFE)}), FALSE)",
    "is_not_validated": "NOT human_validated",
    "has_evidence": "usage_evidence.kind IS NOT NULL",
    "usage_is_counted": "NOT (usage_evidence.kind = 'observed_reaction_usage') OR usage_evidence.conversation_uses >= 1",
    "name_is_unique": "key IS NULL OR (SELECT count(*) FROM r x WHERE x.key = r.key) = 1",
    "media_is_unique": "media_url IS NULL OR (SELECT count(*) FROM r x WHERE x.media_url = r.media_url) = 1",
    "name_is_new": f"NOT coalesce(key IN (SELECT {NAME_SQL.format('name')} FROM catalogue WHERE name IS NOT NULL) AND key <> '', FALSE)",
}
CANDIDATE_SQL = f"WITH r AS (SELECT *, {NAME_SQL.format('name')} AS key FROM (SELECT DISTINCT ON (proposed_id) * FROM stage_3000_reaction_gif_replacements)), v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule FROM r WHERE NOT coalesce({c}, FALSE)" for k, c in _RULES.items()) + ") SELECT rule, count(*) AS n FROM v GROUP BY rule"

#: Answers as a model might give them, made from the cases: good ones, and one fault each by the length of the case's id and title.
_ANSWER = """
  concat('```json\\n{{"decision":"', CASE WHEN n % 11 = 3 THEN 'maybe' WHEN n % 7 = 1 THEN 'none' ELSE 'meme' END, '","confidence":"', CASE WHEN n % 13 = 5 THEN 'certain' WHEN n % 7 = 1 THEN 'low' ELSE 'high' END,
    '","none_reason":"', CASE WHEN n % 7 = 1 AND n % 5 <> 2 THEN 'nothing fits' ELSE '' END, '","candidates":[', CASE WHEN n % 7 = 1 AND n % 17 <> 8 THEN '' ELSE concat('{{"id":"', target, '","score":', CASE WHEN n % 19 = 4 THEN '140' ELSE '88' END, ',"reason":"', CASE WHEN n % 23 = 6 THEN ' ' ELSE 'it shows the contrast' END, '"}}',
      CASE WHEN n % 3 = 0 THEN concat(',{{"id":"', CASE WHEN n % 9 = 0 THEN target ELSE 'unknown-image' END, '","score":70,"reason":"second best"}}') ELSE '' END) END, CASE WHEN n % 29 = 7 THEN ']' ELSE ']}}' END, '\\n```')"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = once(spark, d, "relevance_stage3000_fresh_humour", "id", "title", "primary_target_id")
    e = e.select("id", F.col("primary_target_id").alias("target"), (F.length("id") + F.length(F.coalesce("title", F.lit(""))) * 7 + F.coalesce(F.regexp_extract("id", r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(0))).alias("n")).where("target is not null")
    return e.select("id", F.expr(_ANSWER.format()).alias("answer"))


def answer_rules(spark: SparkSession, d: str) -> DataFrame:
    """Model answers in code fences, parsed and judged: the first fault of each, none if it is good."""
    known = once(spark, d, "catalogue", "id", "name").select("id").unionByName(t(spark, d, "canonical_memes").select("id")).distinct()
    return V.judged(_answers(spark, d), "id", "answer", known).select("id", F.coalesce("fault", F.lit("good")).alias("fault"))


def answer_normalised(spark: SparkSession, d: str) -> DataFrame:
    """The same answers put into order: decision and confidence that fit the candidates, scores falling strictly."""
    return V.normalised(_answers(spark, d), "id", "answer").select("id", "decision", "confidence", "none_reason", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["id"], c["score"].cast("string"))), ",").alias("candidates"))


_PARSED = r"""
WITH e AS (SELECT id, primary_target_id AS target, length(id) + length(coalesce(title, '')) * 7 + coalesce(TRY_CAST(regexp_extract(id, '(\d+)\D*$', 1) AS BIGINT), 0) AS n FROM (SELECT DISTINCT ON (id) * FROM relevance_stage3000_fresh_humour) WHERE primary_target_id IS NOT NULL),
  a AS (SELECT id, regexp_replace(regexp_replace(trim(ANSWER), '^```(?:json)?\s*', '', 'i'), '\s*```$', '') AS x FROM e),
  j AS (SELECT id, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM a),
  p AS (SELECT id, j, j->>'decision' AS decision, j->>'confidence' AS confidence, j->>'none_reason' AS none_reason, from_json(j->'candidates', '[{"id":"VARCHAR","score":"BIGINT","reason":"VARCHAR"}]') AS c FROM j)""".replace("ANSWER", _ANSWER.format().replace("\\n", "' || chr(10) || '"))
FAULT_SQL = _PARSED + """,
  k AS (SELECT id FROM catalogue UNION SELECT id FROM canonical_memes),
  o AS (SELECT p.id, count(*) FILTER (WHERE x.c.id NOT IN (SELECT id FROM k)) AS strange FROM p, (SELECT id, unnest(c) AS c FROM p) x WHERE x.id = p.id GROUP BY p.id)
SELECT p.id, CASE WHEN j IS NULL THEN 'not_json' WHEN decision NOT IN ('meme', 'none') THEN 'decision' WHEN confidence NOT IN ('high', 'medium', 'low') THEN 'confidence' WHEN len(c) > 5 THEN 'too_many' WHEN coalesce(strange, 0) > 0 THEN 'unknown_candidate' WHEN len(list_filter(c, lambda x: trim(x.reason) = '')) > 0 THEN 'reason'
  WHEN len(list_filter(c, lambda x: x.score < 0 OR x.score > 100)) > 0 THEN 'score' WHEN len(list_distinct(list_transform(c, lambda x: x.id))) < len(c) THEN 'duplicate' WHEN decision = 'meme' AND len(c) = 0 THEN 'no_candidates' WHEN decision = 'none' AND (len(c) > 0 OR trim(none_reason) = '') THEN 'contradiction' WHEN decision = 'none' AND confidence <> 'low' THEN 'contradiction' ELSE 'good' END AS fault
FROM p LEFT JOIN o ON o.id = p.id"""
NORMAL_SQL = _PARSED + """,
  s AS (SELECT id, confidence, none_reason, list_sort(list_transform(c, lambda x, i: {s: -least(greatest(coalesce(x.score, 60), 0), 100), i: i, id: x.id})) AS c FROM p WHERE j IS NOT NULL)
SELECT id, CASE WHEN len(c) > 0 THEN 'meme' ELSE 'none' END AS decision, CASE WHEN len(c) = 0 THEN 'low' WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'low' END AS confidence,
  CASE WHEN len(c) > 0 THEN '' WHEN trim(none_reason) <> '' THEN none_reason ELSE 'Nothing known is a natural fit.' END AS none_reason,
  array_to_string(list_transform(c, lambda x, i: x.id || ':' || CASE WHEN i = 1 THEN -x.s ELSE greatest(0, least(-x.s, -c[1].s - i + 1)) END), ',') AS candidates FROM s"""


def safety_rates(spark: SparkSession, d: str) -> DataFrame:
    """Abstention and joking rates over all evaluation and training cases, the classifier's answers replayed from the cases' lengths."""
    e = once(spark, d, "relevance_stage3000_fresh_humour", "id", "context", "intent_label").select("context", (F.col("intent_label") == "humour").alias("wants_humour"))
    s = once(spark, d, "smoke_cases", "id", "context", "category").select("context", F.coalesce(F.col("category") != "sincere-request", F.lit(True)).alias("wants_humour"))
    x = e.unionByName(s).where("context is not null and wants_humour is not null")
    c = F.col("context")
    return M.abstentions(x.select("wants_humour", T.factual(c).alias("factual"), T.serious(c).alias("serious"), (F.length(c) % 3 == 0).alias("humour_ok")))


SAFETY_SQL = f"""
WITH x AS (SELECT context, intent_label = 'humour' AS w FROM (SELECT DISTINCT id, context, intent_label FROM relevance_stage3000_fresh_humour) UNION ALL SELECT context, coalesce(category <> 'sincere-request', TRUE) FROM (SELECT DISTINCT id, context, category FROM smoke_cases)),
  f AS (SELECT w, length(context) % 3 = 0 AS ok, regexp_matches(context, {sql_text(P.FACTUAL_REQUEST)}) AND regexp_matches(context, {sql_text(P.FACTUAL_DOMAIN)}) AS factual,
    regexp_matches(context, {sql_text(P.HELP_SEEKING)}) OR regexp_matches(context, {sql_text(P.HIGH_RISK)}) OR regexp_matches(context, {sql_text(P.SUPPORT_REQUEST)}) OR regexp_matches(context, {sql_text(P.SERIOUS_TOPIC)}) AS serious FROM x WHERE context IS NOT NULL AND w IS NOT NULL),
  g AS (SELECT w, factual OR serious AS cue, serious AND NOT factual AS called, factual OR (serious AND NOT ok) AS declined FROM f),
  a AS (SELECT count(*) AS n_cases, coalesce(CAST(count(*) FILTER (WHERE NOT w AND declined) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT w), 0), 0) AS yes, coalesce(CAST(count(*) FILTER (WHERE NOT w AND NOT declined) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT w), 0), 0) AS no,
    coalesce(CAST(count(*) FILTER (WHERE w AND declined) AS DOUBLE) / nullif(count(*) FILTER (WHERE w), 0), 0) AS wrong, CAST(count(*) FILTER (WHERE cue) AS DOUBLE) / count(*) AS cues, CAST(count(*) FILTER (WHERE called) AS DOUBLE) / count(*) AS calls FROM g)
SELECT n_cases, {r6("yes")} AS correct_abstention, {r6("no")} AS inappropriate_joking, {r6("1 - wrong")} AS humour_recall, {r6("wrong")} AS false_abstention, {r6("cues")} AS cue_rate, {r6("calls")} AS call_rate FROM a"""


def top_places(spark: SparkSession, d: str) -> DataFrame:
    """What the first line of each order by discount is worth, rated by tax."""
    x = lines(spark, d).select("l_orderkey", "id", F.col("l_discount").alias("score"), F.floor(F.col("l_tax") * 100 / 2 + 0.01).cast("int").alias("rating"))
    return M.top_ratings(x, "l_orderkey", "id", "score", "rating")


TOP_SQL = f"""
WITH x AS (SELECT l_orderkey, id, l_discount AS score, CAST(floor(l_tax * 100 / 2 + 0.01::DOUBLE) AS INT) AS rating FROM {LINES_SQL})
SELECT l_orderkey, arg_min(rating, {{s: -score, i: id}}) = max(rating) AS top_is_best, arg_min(rating, {{s: -score, i: id}}) AS top_rating, bool_or(rating >= 4) AS any_exact, bool_or(rating >= 3) AS any_sendable FROM x GROUP BY l_orderkey"""


def arms_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Arms (order priorities) by gain, hits, error and latency, and the best one that isn't the baseline."""
    x = lines(spark, d).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("arm")), "l_orderkey")
    g = x.groupBy("arm").agg(N.rounded(F.avg(F.col("l_tax") * 10)).alias("ndcg"), N.rounded(M.rate(F.col("l_discount") > 0.05)).alias("top_one"), N.rounded(F.avg(F.abs(F.col("l_quantity") - 25))).alias("mae"), M.nearest_rank("l_extendedprice", 0.95).alias("p95"))
    order = [F.desc("ndcg"), F.desc("top_one"), F.col("mae"), F.col("p95"), F.col("arm")]
    ranked = g.select("*", F.row_number().over(_all(*order)).alias("place"))  # a handful of arms
    return ranked.withColumn("promoted", (F.row_number().over(_all(F.col("arm") == "1-URGENT", *order)) == 1) & (F.col("arm") != "1-URGENT"))


def _all(*order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)


ARMS_SQL = f"""
WITH g AS (SELECT o_orderpriority AS arm, {r6("avg(l_tax * 10)")} AS ndcg, {r6("CAST(count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS DOUBLE) / count(*)")} AS top_one, {r6("avg(abs(l_quantity - 25))")} AS mae, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY ndcg DESC, top_one DESC, mae, p95, arm) AS INT) AS place, row_number() OVER (ORDER BY arm = '1-URGENT', ndcg DESC, top_one DESC, mae, p95, arm) = 1 AND arm <> '1-URGENT' AS promoted FROM g"""


def descending_selection(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best records of each scope, all keys falling, the id too."""
    s = once(spark, d, "stage_3000_local_signals", "id", "scope", "meme_strength", "asset_quality", "reaction_fit")
    return top_k(s, ["scope"], 50, F.desc_nulls_last("reaction_fit"), F.desc_nulls_last("meme_strength"), F.desc_nulls_last("asset_quality"), F.desc("id")).select("scope", "id", "rank")


DESC_SQL = "SELECT scope, id, rank FROM (SELECT scope, id, CAST(row_number() OVER (PARTITION BY scope ORDER BY reaction_fit DESC NULLS LAST, meme_strength DESC NULLS LAST, asset_quality DESC NULLS LAST, id DESC) AS INT) AS rank FROM (SELECT DISTINCT id, scope, meme_strength, asset_quality, reaction_fit FROM stage_3000_local_signals)) WHERE rank <= 50"


def first_acceptable(spark: SparkSession, d: str) -> DataFrame:
    """The best place of each order's returned lines among its lines by price, and the lines beyond the third place."""
    x = lines(spark, d).select(F.col("l_orderkey").alias("query_id"), "id", "l_extendedprice", "l_returnflag")
    ranked = top_k(x, ["query_id"], 3, F.desc("l_extendedprice"), F.col("id"))
    out = M.first_ranks(ranked, x.where("l_returnflag = 'R'").select("query_id", "id"))
    return out.select("query_id", "first_rank", F.array_join(F.transform("missed", lambda i: i.cast("string")), ",").alias("missed"))


FIRST_SQL = f"""
WITH x AS (SELECT l_orderkey AS query_id, id, l_returnflag, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, id) AS INT) AS rank FROM {LINES_SQL})
SELECT query_id, min(CASE WHEN rank <= 3 THEN rank END) AS first_rank, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE rank > 3), '') AS missed FROM x WHERE l_returnflag = 'R' GROUP BY query_id"""


def seed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of seed records: all texts, tags, provenance, rights, media and review."""
    r = once(spark, d, "stage_300_seed", "id", *TEXTS, "tags", "provenance", "media", "review")
    rules = [Q.Rule("id_is_slug", F.col("id").rlike(SLUG)), *[Q.Rule(f"has_{c}", F.length(F.trim(c)) > 0) for c in TEXTS]]
    rules += [
        Q.Rule("two_tags", (F.size("tags") >= 2) & ~F.exists("tags", lambda x: x.isNull() | (F.trim(x) == ""))),
        Q.Rule("has_provenance", F.col("provenance.provider").isNotNull() & _https("provenance.source_url") & F.col("provenance.observed_on").isNotNull()),
        Q.Rule("has_rights", F.col("media.rights_status").isNotNull()),
        Q.Rule("media_is_https", _https("media.image_url")),
        Q.Rule("is_not_validated", F.col("review.status").isNotNull() & ~F.col("review.human_validated")),
    ]
    clash = once(spark, d, "catalogue", "id", "name").select("id").join(r.select("id"), "id", "left_semi").select(F.col("id").alias("row_id"), F.lit("id_is_new").alias("rule"))
    return Q.violations(r, "id", rules).unionByName(clash).groupBy("rule").agg(F.count("*").alias("n"))


TEXTS = ["name", "message", "relational_pattern", "example_context", "near_miss_context"]
_SEED = {"id_is_slug": f"regexp_matches(id, '{SLUG}')"} | {f"has_{c}": f"length(trim({c})) > 0" for c in TEXTS} | {
    "two_tags": "len(tags) >= 2 AND len(list_filter(tags, lambda x: x IS NULL OR trim(x) = '')) = 0",
    "has_provenance": "provenance.provider IS NOT NULL AND starts_with(lower(provenance.source_url), 'https://') AND provenance.observed_on IS NOT NULL",
    "has_rights": "media.rights_status IS NOT NULL",
    "media_is_https": "starts_with(lower(media.image_url), 'https://')",
    "is_not_validated": "review.status IS NOT NULL AND NOT review.human_validated",
    "id_is_new": "id NOT IN (SELECT id FROM catalogue)",
}
SEED_SQL = "WITH r AS (SELECT DISTINCT ON (id) * FROM stage_300_seed), v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule FROM r WHERE NOT coalesce({c}, FALSE)" for k, c in _SEED.items()) + ") SELECT rule, count(*) AS n FROM v GROUP BY rule"


def case_set_rules(spark: SparkSession, d: str) -> DataFrame:
    """A set of cases as a whole: expected counts, targets used once, contexts once, and rows that differ from frozen ones."""
    e = once(spark, d, "relevance_stage3000_fresh_humour", "id", "title", "context", "intent_label", "primary_target_id")
    frozen = e.select("id", F.trim("title").alias("title"), "context", "intent_label")
    wrong = Q.counts(e, {"humour_cases_300": (F.col("intent_label") == "humour", 300), "no_cases_without_meme": (F.col("intent_label") == "no_meme", 0), "all_have_targets": (F.col("primary_target_id").isNull(), 0), "short_contexts": (F.length("context") < 30, 0)})
    rows = Q.violations(e, "id", [Q.Rule("target_is_unique", Q.unique("primary_target_id")), Q.Rule("context_is_unique", Q.unique("context"))])
    differ = C.changed(frozen, e, "id", ["title", "context", "intent_label"]).select(F.col("id").alias("row_id"), F.concat(F.lit("frozen_"), "column").alias("rule"))
    return wrong.unionByName(rows).unionByName(differ).groupBy("rule").agg(F.count("*").alias("n"))


SET_SQL = """
WITH e AS (SELECT DISTINCT ON (id) * FROM relevance_stage3000_fresh_humour),
  v AS (SELECT 'humour_cases_300' AS rule FROM e HAVING count(*) FILTER (WHERE intent_label = 'humour') <> 300 UNION ALL SELECT 'no_cases_without_meme' FROM e HAVING count(*) FILTER (WHERE intent_label = 'no_meme') <> 0
    UNION ALL SELECT 'all_have_targets' FROM e HAVING count(*) FILTER (WHERE primary_target_id IS NULL) <> 0 UNION ALL SELECT 'short_contexts' FROM e HAVING count(*) FILTER (WHERE length(context) < 30) <> 0
    UNION ALL SELECT 'target_is_unique' FROM e WHERE primary_target_id IN (SELECT primary_target_id FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'context_is_unique' FROM e WHERE context IN (SELECT context FROM e GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'frozen_title' FROM e WHERE title IS DISTINCT FROM trim(title, ' '))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def competitive_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines' scores can't be used, and why."""
    x = lines(spark, d).select("l_orderkey", F.when(F.col("l_discount") < 0.1, F.col("l_discount") * 10).alias("score"))
    return R.competitive(x, "l_orderkey", "score").select("l_orderkey", F.coalesce("fault", F.lit("good")).alias("fault"))


COMPETITIVE_SQL = f"""
WITH x AS (SELECT l_orderkey, CASE WHEN l_discount < 0.1::DOUBLE THEN l_discount * 10 END AS s FROM {LINES_SQL})
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE s IS NULL OR s < 0 OR s > 1) > 0 THEN 'incomplete' WHEN count(*) > 1 AND min(s) = max(s) THEN 'flat' ELSE 'good' END AS fault FROM x GROUP BY l_orderkey"""


def next_unreviewed(spark: SparkSession, d: str) -> DataFrame:
    """For each customer the next open order after their latest closed one, else the first open one."""
    o = t(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("at")).join(o.where("o_orderstatus = 'O'"), "o_custkey")
    return g.groupBy("o_custkey").agg(F.coalesce(F.min(F.when(F.col("o_orderkey") > F.col("at"), F.col("o_orderkey"))), F.min("o_orderkey")).alias("next"))


NEXT_SQL = """
WITH a AS (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS closed FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(min(o_orderkey) FILTER (WHERE o_orderkey > closed), min(o_orderkey)) AS next FROM orders JOIN a USING (o_custkey) WHERE o_orderstatus = 'O' GROUP BY o_custkey"""


def presented(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of each recommendation: place, public fields of its record and a perspective."""
    public = once(spark, d, "catalogue", "id", "name", "message", "image_url", "media_status")
    got = recommend_batch(spark, d).where("id is not null")
    shown = got.join(public, "id").select("query_id", "rank", "id", "name", "image_url", F.coalesce("media_status", F.lit("unknown")).alias("media_status"), F.when(F.col("mode") == "perspective", "situation").otherwise("general").alias("perspective"))
    return shown


PRESENTED_SQL = f"""
SELECT x.query_id, x.rank, x.id, c.name, c.image_url, coalesce(c.media_status, 'unknown') AS media_status, CASE WHEN x.mode = 'perspective' THEN 'situation' ELSE 'general' END AS perspective
FROM ({RECOMMEND_SQL}) x JOIN (SELECT DISTINCT id, name, image_url, media_status FROM catalogue) c ON c.id = x.id WHERE x.id IS NOT NULL"""


def arm_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval without core rows."""
    return R.retrieve_arm("expansion", *_vectors(spark, d), VIEWS, F.col("label") < 3)


def arm_controlled(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval of fifty places, thirty of them for core rows."""
    return R.retrieve_arm("controlled", *_vectors(spark, d), VIEWS, F.col("label") < 3)


ARM_SQL = f"SELECT query_id, id, rank FROM ({_fuse_sql(_view_sql('c.label >= 3'))})"
CONTROLLED_SQL = f"""
WITH b AS ({_fuse_sql(_view_sql(k=50), 50)}), c AS ({_fuse_sql(_view_sql("c.label < 3", 50), 50)}),
  m AS (SELECT query_id, id, CASE WHEN rank <= 20 THEN rank ELSE rank + 1030 END AS place FROM b UNION ALL SELECT query_id, id, rank + 20 FROM c WHERE rank <= 30),
  g AS (SELECT query_id, id, min(place) AS place FROM m GROUP BY query_id, id)
SELECT query_id, id, rank FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank FROM g) WHERE rank <= 50"""


def arm_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of conditions over orders taken as arms of experiments."""
    o = t(spark, d, "orders")
    pick = lambda n, yes, no: F.when(n, yes).otherwise(no)
    x = o.select("o_orderpriority", pick(F.col("o_orderstatus") == "P", "error", "ok").alias("status"), pick(F.col("o_totalprice") > 100000, "meme", "none").alias("decision"), pick(F.col("o_custkey") % 4 == 0, "no_meme", "humour").alias("intent_label"), F.when(F.col("o_orderkey") % 5 != 0, pick(F.col("o_orderkey") % 3 == 0, "send", "miss")).alias("verdict"), (F.col("o_custkey") % 7).alias("first_id"), (F.col("o_orderkey") % 7).alias("verdict_id"))
    return M.condition_counts(x, "o_orderpriority")


COUNTERS_SQL = """
WITH x AS (SELECT o_orderpriority, o_orderstatus <> 'P' AS ok, o_totalprice > 100000 AS meme, o_custkey % 4 = 0 AS bare, o_orderkey % 5 <> 0 AS seen, o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AS send, o_custkey % 7 = o_orderkey % 7 AS first FROM orders)
SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE ok AND seen) AS reviewed, count(*) FILTER (WHERE ok AND meme) AS meme_decisions, count(*) FILTER (WHERE ok AND NOT meme) AS none_decisions, count(*) FILTER (WHERE ok AND seen AND NOT bare) AS humour_reviewed,
  count(*) FILTER (WHERE ok AND send AND NOT bare AND first) AS top_one_sendable, count(*) FILTER (WHERE ok AND send AND NOT bare) AS top_three_sendable, count(*) FILTER (WHERE ok AND bare) AS no_meme_cases, count(*) FILTER (WHERE ok AND bare AND NOT meme) AS correct_abstentions, count(*) FILTER (WHERE ok AND bare AND meme) AS inappropriate_joking FROM x GROUP BY o_orderpriority"""


def vector_faults(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that can't be searched with, by reason."""
    e = once(spark, d, "stage_3000_local_signals", "id", "embedding")
    return e.groupBy(F.coalesce(M.vector_fault("embedding", 64), F.lit("good")).alias("fault")).agg(F.count("*").alias("n"))


VECTOR_SQL = """
SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong_length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'good' END AS fault, count(*) AS n
FROM (SELECT DISTINCT ON (id) id, embedding FROM stage_3000_local_signals) GROUP BY 1"""


def review_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of reviews (purchases and refunds taken as verdicts): known kind, an arm seen before, a short note."""
    e = t(spark, d, "events")
    arms = e.where("event_type = 'view'").select("user_id").distinct()
    reviews = e.where("event_type <> 'view'")
    rules = [Q.Rule("verdict_is_known", F.col("event_type").isin("click", "purchase")), Q.Rule("note_is_short", F.length(F.coalesce("props", F.lit(""))) <= 8), Q.Rule("value_is_given", F.col("value").isNotNull())]
    return Q.violations(reviews, "event_id", rules).unionByName(Q.known(reviews, "event_id", "user_id", arms, "user_id", "arm_is_known")).groupBy("rule").agg(F.count("*").alias("n"))


REVIEW_SQL = """
WITH r AS (SELECT * FROM events WHERE event_type <> 'view'),
  v AS (SELECT 'verdict_is_known' AS rule FROM r WHERE event_type NOT IN ('click', 'purchase') UNION ALL SELECT 'note_is_short' FROM r WHERE length(coalesce(props, '')) > 8 UNION ALL SELECT 'value_is_given' FROM r WHERE value IS NULL
    UNION ALL SELECT 'arm_is_known' FROM r WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND user_id IS NOT NULL))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def image_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images linked by vectors whose signs differ in five places at most, each with the least id of its group."""
    images = image_signs(spark, d).persist(StorageLevel.DISK_ONLY)
    # images with the same signs are one node, so edges and labels are numbers and copies make no pairs
    own = images.groupBy("bits").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    linked = graph.groups(S.bit_values(images, "bits", 5), "va", "vb").withColumnRenamed("node", "bits")
    own = own.join(linked, "bits", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "bits"))
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    named = own.join(least, "root").select("bits", F.col("least").alias("root"))
    return images.join(named, "bits").select(F.col("pos").alias("node"), "root")


GROUP_SQL = f"""
WITH RECURSIVE h AS ({HAMMING_SQL}), b AS (SELECT pos_a AS x, pos_b AS y FROM h UNION ALL SELECT pos_b, pos_a FROM h), r AS (SELECT x AS node, y AS root FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.root = b.x)
SELECT node, least(node, min(root)) AS root FROM r GROUP BY node"""


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="mirthlake-files-")


def files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders through JSON lines, nations through CSV, signals through Parquet and back, counted and summed."""
    at = _folder(spark)
    t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").write.json(f"{at}/orders")
    t(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(f"{at}/nation")
    once(spark, d, "stage_3000_local_signals", "id", "width").write.parquet(f"{at}/signals")
    o = spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderpriority string").json(f"{at}/orders").agg(F.lit("orders").alias("what"), F.count("*").alias("n"), F.sum("o_custkey").alias("total"))
    n = spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(f"{at}/nation").agg(F.lit("nation").alias("what"), F.count("n_name").alias("n"), F.sum("n_nationkey").alias("total"))
    s = spark.read.parquet(f"{at}/signals").agg(F.lit("signals").alias("what"), F.count("*").alias("n"), F.sum("width").alias("total"))
    return o.unionAll(n).unionAll(s)


FILES_SQL = """
SELECT 'orders' AS what, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation
UNION ALL SELECT 'signals', count(*), CAST(sum(width) AS BIGINT) FROM (SELECT DISTINCT id, width FROM stage_3000_local_signals)"""

QUERIES = {f.__name__: f for f in (candidate_rules, answer_rules, answer_normalised, safety_rates, top_places, arms_ranked, descending_selection, first_acceptable, seed_rules, case_set_rules, competitive_scores, next_unreviewed, presented, arm_expansion, arm_controlled, arm_counters, vector_faults, review_rules, image_groups, files_round_trip)}
SQL = {
    "candidate_rules": CANDIDATE_SQL,
    "answer_rules": FAULT_SQL,
    "answer_normalised": NORMAL_SQL,
    "safety_rates": SAFETY_SQL,
    "top_places": TOP_SQL,
    "arms_ranked": ARMS_SQL,
    "descending_selection": DESC_SQL,
    "first_acceptable": FIRST_SQL,
    "seed_rules": SEED_SQL,
    "case_set_rules": SET_SQL,
    "competitive_scores": COMPETITIVE_SQL,
    "next_unreviewed": NEXT_SQL,
    "presented": PRESENTED_SQL,
    "arm_expansion": ARM_SQL,
    "arm_controlled": CONTROLLED_SQL,
    "arm_counters": COUNTERS_SQL,
    "vector_faults": VECTOR_SQL,
    "review_rules": REVIEW_SQL,
    "image_groups": GROUP_SQL,
    "files_round_trip": FILES_SQL,
}
