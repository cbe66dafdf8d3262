"""Queries: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import metrics as M
from .common import LINES_SQL, lines, once, r6, t
from .retrieval import COMMENTS_SQL, DOCS_SQL, _comments, _documents, bm25_sql
from ..operators import retrieval as R

# Order lines stand for scored candidates: score 0..100 from the price, rating 0..4 from the quantity.
_RATED = "CAST(floor((l_quantity - 1) / 10.0) AS INT)"
RATED_SQL = f"(SELECT l_orderkey, id, floor(l_extendedprice / 1000) AS score, least({_RATED}, 4) AS rating FROM {LINES_SQL})"


def _rated(spark, d):
    return lines(spark, d).select("l_orderkey", "id", F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("score"), F.least(F.floor((F.col("l_quantity") - 1) / 10).cast("int"), F.lit(4)).alias("rating"))


def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return M.ndcg(_rated(spark, d), "l_orderkey", "id", "score", "rating", 5)


NDCG_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, id) AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY rating DESC, id) AS b, pow(2.0::DOUBLE, rating) - 1 AS v FROM {RATED_SQL}),
  s AS (SELECT l_orderkey, sum(CASE WHEN g <= 5 THEN v / log2(g + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 5 THEN v / log2(b + 1) ELSE 0 END) AS ideal FROM r GROUP BY l_orderkey)
SELECT l_orderkey, {r6("CASE WHEN ideal = 0 THEN 0.0::DOUBLE ELSE dcg / ideal END")} AS ndcg FROM s"""


def pairwise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return M.pairwise_accuracy(_rated(spark, d), "l_orderkey", "score", F.col("rating") >= 3).select("l_orderkey", "accuracy", F.col("n_pairs").cast("bigint").alias("n_pairs"))


PAIRWISE_SQL = f"""
WITH p AS (SELECT a.l_orderkey, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE AS w FROM {RATED_SQL} a JOIN {RATED_SQL} b ON a.l_orderkey = b.l_orderkey WHERE a.rating >= 3 AND b.rating < 3)
SELECT o.l_orderkey, {r6("avg(w)")} AS accuracy, count(w) AS n_pairs FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN p ON p.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey"""


def graded_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return M.graded_accuracy(_rated(spark, d), "l_orderkey", "id", "score", "rating")


GRADED_SQL = f"""
SELECT a.l_orderkey, {r6("avg(CASE WHEN a.score = b.score THEN 0.5 WHEN sign(a.score - b.score) = sign(a.rating - b.rating) THEN 1.0 ELSE 0.0 END::DOUBLE)")} AS accuracy, count(*) AS n_pairs
FROM {RATED_SQL} a JOIN {RATED_SQL} b ON a.l_orderkey = b.l_orderkey AND a.id < b.id AND a.rating <> b.rating GROUP BY a.l_orderkey"""


def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    r = lines(spark, d).select("l_returnflag", (F.col("l_discount") * 1000).alias("score"), F.least(F.floor((F.col("l_quantity") - 1) / 10).cast("int"), F.lit(4)).alias("rating"))
    return r.groupBy("l_returnflag").agg(*M.calibration(F.col("score"), F.col("rating") >= 3, F.col("rating")), F.count("*").alias("n"))


CALIBRATION_SQL = f"""
WITH r AS (SELECT l_returnflag, l_discount * 1000 AS score, least({_RATED}, 4) AS rating FROM lineitem)
SELECT l_returnflag, {r6("avg(pow(score / 100 - CAST(rating >= 3 AS DOUBLE), 2))")} AS brier, {r6("avg(abs(score - 25 * rating))")} AS ordinal_mae, {r6("avg(CASE WHEN score >= 75 THEN CAST(rating >= 3 AS DOUBLE) END)")} AS high_precision,
  CAST(count(*) FILTER (WHERE score >= 75 AND rating <= 1) AS BIGINT) AS n_wrongly_high, count(*) AS n FROM r GROUP BY l_returnflag"""


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Does lexical retrieval find the record that a case was written for?"""
    ranked = R.bm25(_comments(spark, d), _documents(spark, d), 50)
    ok = once(spark, d, "relevance_stage3000_fresh_humour", "id", "primary_target_id", "acceptable_ids").select(F.col("id").alias("query_id"), F.explode(F.array_distinct(F.concat(F.coalesce("acceptable_ids", F.array().cast("array<string>")), F.array("primary_target_id")))).alias("id")).where("id is not null")
    return M.recall_at(ranked, ok, [10, 30, 50])


RECALL_SQL = f"""
WITH {bm25_sql(COMMENTS_SQL, DOCS_SQL, 50)},
  a AS (SELECT DISTINCT id AS query_id, unnest(list_concat(coalesce(acceptable_ids, []), [primary_target_id])) AS id FROM (SELECT DISTINCT ON (id) * FROM relevance_stage3000_fresh_humour)),
  f AS (SELECT a.query_id, min(rank) AS first_rank FROM a LEFT JOIN ranked r ON r.query_id = a.query_id AND r.id = a.id WHERE a.id IS NOT NULL GROUP BY a.query_id)
SELECT count(*) AS n_cases, {", ".join(r6(f"CAST(count(*) FILTER (WHERE first_rank <= {k}) AS DOUBLE) / count(*)") + f" AS recall_at_{k}" for k in (10, 30, 50))} FROM f"""


def gap_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Cases by the first gap that explains them, from replayed flags."""
    o = t(spark, d, "orders").select((F.col("o_orderkey") % 11 != 0).alias("in_data"), (F.col("o_orderkey") % 13 == 0).alias("failed"), (F.col("o_orderstatus") != "P").alias("humour"), (F.col("o_totalprice") > 50000).alias("retrieved"), F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 3 + 1).cast("int")).alias("top_rank"))
    return o.groupBy(M.diagnosis().alias("diagnosis")).agg(F.count("*").alias("n"))


GAP_SQL = """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'data_gap' WHEN o_orderkey % 13 = 0 THEN 'provider_gap' WHEN o_orderstatus = 'P' THEN 'safety_gap' WHEN NOT o_totalprice > 50000 THEN 'retrieval_gap'
  WHEN o_custkey % 5 = 0 THEN 'ranking_gap' WHEN o_custkey % 3 + 1 > 1 THEN 'ordering_gap' ELSE 'pass' END AS diagnosis, count(*) AS n FROM orders GROUP BY 1"""


def safety_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates on documents by language: how often a cue fires, how often the classifier is called, how often either is silent."""
    from ..functions import text as T

    x = t(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("?")).alias("lang"), T.serious(F.col("text")).alias("cue"), T.factual(F.col("text")).alias("factual"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), N.rounded(M.rate(F.col("cue"))).alias("cue_rate"), N.rounded(M.rate(F.col("cue") & ~F.col("factual"))).alias("call_rate"), N.rounded(M.rate(F.col("factual"), F.col("cue"), guarded=True)).alias("factual_given_cue"))


def _safety_sql():
    from ..functions import patterns as P
    from .common import sql_text

    cue = " OR ".join(f"regexp_matches(text, {sql_text(p)})" for p in (P.HELP_SEEKING, P.HIGH_RISK, P.SUPPORT_REQUEST, P.SERIOUS_TOPIC))
    fact = f"regexp_matches(text, {sql_text(P.FACTUAL_REQUEST)}) AND regexp_matches(text, {sql_text(P.FACTUAL_DOMAIN)})"
    return f"""
WITH x AS (SELECT coalesce(lang, '?') AS lang, ({cue}) AS cue, ({fact}) AS factual FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS n, {r6("CAST(count(*) FILTER (WHERE cue) AS DOUBLE) / count(*)")} AS cue_rate, {r6("CAST(count(*) FILTER (WHERE cue AND NOT factual) AS DOUBLE) / count(*)")} AS call_rate,
  {r6("coalesce(CAST(count(*) FILTER (WHERE cue AND factual) AS DOUBLE) / nullif(count(*) FILTER (WHERE cue), 0), 0)")} AS factual_given_cue FROM x GROUP BY lang"""


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type").agg(M.nearest_rank("value", 0.5).alias("p50"), M.nearest_rank("value", 0.95).alias("p95"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


LATENCY_SQL = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, median(value) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type"


def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two raters of each order: price and status; agreement and consensus by priority."""
    o = t(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") > 150000).alias("a"), (F.col("o_custkey") % 2 == 0).alias("b"))
    return o.groupBy("o_orderpriority").agg(N.rounded(M.rate(F.col("a") == F.col("b"))).alias("agreement"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.bool_and(F.col("a") == F.col("b")).alias("consensus"), F.count("*").alias("n"))


AGREEMENT_SQL = f"SELECT o_orderpriority, {r6('CAST(count(*) FILTER (WHERE (o_totalprice > 150000) = (o_custkey % 2 = 0)) AS DOUBLE) / count(*)')} AS agreement, count(*) FILTER (WHERE o_totalprice > 150000 AND o_custkey % 2 = 0) AS both, bool_and((o_totalprice > 150000) = (o_custkey % 2 = 0)) AS consensus, count(*) AS n FROM orders GROUP BY o_orderpriority"


def win_loss_tie(spark: SparkSession, d: str) -> DataFrame:
    """Two conditions compared case by case: a customer's open and finished orders."""
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") / 50000))).alias("a"), F.avg(F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 50000))).alias("b"))
    return o.where("a is not null and b is not null").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


WIN_SQL = """
WITH x AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice / 50000) END) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 50000) END) AS b FROM orders GROUP BY 1)
SELECT count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM x WHERE a IS NOT NULL AND b IS NOT NULL"""


def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same metrics for each source and for all, in one pass by grouping sets."""
    x = t(spark, d, "documents").select("source", "n_chars", F.col("text").isNull().alias("missing"))
    return spark.sql("SELECT coalesce(source, 'all') AS slice, grouping(source) = 1 AS overall, count(*) AS n, sum(n_chars) AS chars, count_if(missing) AS n_missing, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS median_chars FROM {x} GROUP BY GROUPING SETS ((source), ())", x=x)


SLICE_SQL = "SELECT coalesce(source, 'all') AS slice, grouping(source) = 1 AS overall, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE text IS NULL) AS n_missing, quantile_disc(n_chars, 0.5) AS median_chars FROM documents GROUP BY GROUPING SETS ((source), ())"


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against their thresholds, and whether all hold."""
    m = _rated(spark, d).groupBy("l_orderkey").agg(F.max_by("rating", F.struct("score", "id")).alias("top")).agg(N.rounded(F.avg("top")).alias("mean_top"), N.rounded(M.rate(F.col("top") == 4)).alias("exact_rate"))
    g = m.select(F.explode(F.array(F.struct(F.lit("mean_top").alias("metric"), F.col("mean_top").alias("value"), F.lit(2.0).alias("minimum")), F.struct(F.lit("exact_rate").alias("metric"), F.col("exact_rate").alias("value"), F.lit(0.9).alias("minimum")))).alias("x")).select("x.*")
    return g.withColumn("passed", F.col("value") >= F.col("minimum")).withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy(F.lit(1))))


GATE_SQL = f"""
WITH t AS (SELECT rating AS top FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, id DESC) AS i FROM {RATED_SQL}) WHERE i = 1),
  m AS (SELECT {r6("avg(top)")} AS a, {r6("CAST(count(*) FILTER (WHERE top = 4) AS DOUBLE) / count(*)")} AS b FROM t),
  g AS (SELECT 'mean_top' AS metric, a AS value, 2.0::DOUBLE AS minimum FROM m UNION ALL SELECT 'exact_rate', b, 0.9::DOUBLE FROM m)
SELECT *, value >= minimum AS passed, bool_and(value >= minimum) OVER () AS all_passed FROM g"""


def rating_map_top5(spark: SparkSession, d: str) -> DataFrame:
    """Sparse maps of ratings by record, read back as rows: the five best of each map, and a histogram of labels."""
    m = _rated(spark, d).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("id", "rating"))).alias("ratings"))
    r = R.top_k(m.select("l_orderkey", F.explode("ratings").alias("id", "rating")), ["l_orderkey"], 5, F.desc("rating"), F.col("id"))
    return r.groupBy("rating").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("n_first"))


MAP_SQL = f"SELECT rating, count(*) AS n, count(*) FILTER (WHERE i = 1) AS n_first FROM (SELECT rating, row_number() OVER (PARTITION BY l_orderkey ORDER BY rating DESC, id) AS i FROM {RATED_SQL}) WHERE i <= 5 GROUP BY rating"


def selection_union(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that any arm chose for a case: the sorted union, and how often each arm was alone."""
    li = lines(spark, d).select("l_orderkey", "l_returnflag", "l_partkey")
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("candidates"), F.count_distinct("l_returnflag").alias("n_arms"))


UNION_SQL = "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS candidates, count(DISTINCT l_returnflag) AS n_arms FROM lineitem GROUP BY l_orderkey"

QUERIES = {f.__name__: f for f in (ndcg_at_5, pairwise_accuracy, graded_pairwise, calibration_report, recall_at_k, gap_diagnosis, safety_metrics, latency_percentiles, reviewer_agreement, win_loss_tie, slice_metrics, gate_report, rating_map_top5, selection_union)}
SQL = {"ndcg_at_5": NDCG_SQL, "pairwise_accuracy": PAIRWISE_SQL, "graded_pairwise": GRADED_SQL, "calibration_report": CALIBRATION_SQL, "recall_at_k": RECALL_SQL, "gap_diagnosis": GAP_SQL, "safety_metrics": _safety_sql(), "latency_percentiles": LATENCY_SQL, "reviewer_agreement": AGREEMENT_SQL, "win_loss_tie": WIN_SQL, "slice_metrics": SLICE_SQL, "gate_report": GATE_SQL, "rating_map_top5": MAP_SQL, "selection_union": UNION_SQL}
