"""Queries: retrieval and ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as T
from ..operators import ranking as K
from ..operators import retrieval as R
from .common import LINES_SQL, lines, once, r6, sql_list, sql_text, t

VIEWS = {"meaning": (1, 32), "example": (33, 32)}


def _comments(spark, d):
    return once(spark, d, "relevance_stage3000_fresh_humour", "id", "context").select(F.col("id").alias("query_id"), F.col("context").alias("text"))


def _documents(spark, d):
    c = once(spark, d, "catalogue", "id", "name", "message", "relational_pattern", "example_context", "tags")
    return c.select("id", F.concat_ws(" ", "name", "message", "relational_pattern", "example_context", F.array_join("tags", " ")).alias("text"))


def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_comments(spark, d), _documents(spark, d), 3)


STOP = sql_list(P.LEXICAL_STOP)


def bm25_sql(query: str, docs: str, k: int, name: str = "") -> str:
    """CTEs that end in (query_id, id, score, rank) as ranked{name}."""
    return f"""
  q{name} AS (SELECT DISTINCT query_id, w AS word FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM {query}) WHERE length(w) > 1 AND NOT list_contains({STOP}, w)),
  d{name} AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)) AS words FROM {docs}),
  s{name} AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean FROM d{name}),
  tf{name} AS (SELECT id, l, word, count(*) AS tf FROM (SELECT id, len(words) AS l, unnest(words) AS word FROM d{name}) GROUP BY ALL),
  df{name} AS (SELECT word, count(*) AS df FROM tf{name} GROUP BY word),
  scored{name} AS (SELECT query_id, id, {r6("sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / mean)))")} AS score
    FROM q{name} JOIN tf{name} USING (word) JOIN df{name} USING (word), s{name} GROUP BY query_id, id),
  ranked{name} AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM scored{name} WHERE score > 0) WHERE rank <= {k})"""


COMMENTS_SQL = "(SELECT DISTINCT id AS query_id, context AS text FROM relevance_stage3000_fresh_humour)"
DOCS_SQL = "(SELECT DISTINCT id, concat_ws(' ', name, message, relational_pattern, example_context, array_to_string(tags, ' ')) AS text FROM catalogue)"
BM25_SQL = f"WITH {bm25_sql(COMMENTS_SQL, DOCS_SQL, 3)} SELECT query_id, id, score, rank FROM ranked"


def _vectors(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), e.select(F.col("vec_id").alias("id"), "label", "v")


def vector_topk_dual_view(spark: SparkSession, d: str) -> DataFrame:
    return R.dual_view(*_vectors(spark, d), VIEWS, 30)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(R.dual_view(*_vectors(spark, d), VIEWS, 30), 30)


def reserve_merge(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return R.retrieve(q, c, VIEWS, F.col("label") < 3, 30)


def _view_sql(where: str = "TRUE", k: int = 30) -> str:
    parts = []
    for name, (a, n) in VIEWS.items():
        cut = lambda x: f"CAST({x}.embedding[{a}:{a + n - 1}] AS DOUBLE[])"
        parts.append(f"SELECT q.vec_id AS query_id, '{name}' AS list, c.vec_id AS id, {r6(f'list_dot_product({cut("q")}, {cut("c")}) / sqrt(list_dot_product({cut("q")}, {cut("q")})) / sqrt(list_dot_product({cut("c")}, {cut("c")}))')} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND ({where})")
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id) AS INT) AS rank FROM ({' UNION ALL '.join(parts)})) WHERE rank <= {k}"


def _fuse_sql(lists: str, k: int = 30) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, best_score DESC, id) AS INT) AS rank FROM (SELECT query_id, id, floor(sum(1 / (60.0::DOUBLE + rank)) * 1e9 + 0.5) / 1e9 AS rrf, min(rank) AS best_rank, max(score) AS best_score FROM ({lists}) GROUP BY query_id, id)) WHERE rank <= {k}"


RESERVE_SQL = f"""
WITH b AS ({_fuse_sql(_view_sql())}), c AS ({_fuse_sql(_view_sql("c.label < 3"))}),
  m AS (SELECT query_id, id, CASE WHEN rank <= 20 THEN rank ELSE rank + 1010 END AS place FROM b UNION ALL SELECT query_id, id, rank + 20 FROM c WHERE rank <= 10),
  g AS (SELECT query_id, id, min(place) AS place FROM m GROUP BY query_id, id)
SELECT query_id, id, rank FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INT) AS rank FROM g) WHERE rank <= 30"""


def recommend_batch(spark: SparkSession, d: str) -> DataFrame:
    """Comments to five candidates each: two BM25 views fused, gates, fallback scores, labels."""
    comments = _comments(spark, d)
    c = once(spark, d, "catalogue", "id", "name", "message", "relational_pattern", "example_context")
    meaning = R.bm25(comments, c.select("id", F.concat_ws(" ", "name", "message", "relational_pattern").alias("text")), 30).withColumn("list", F.lit("meaning"))
    example = R.bm25(comments, c.select("id", F.col("example_context").alias("text")), 30).withColumn("list", F.lit("example"))
    fused = R.fuse(meaning.unionByName(example), 5)
    gates = comments.select("query_id", F.coalesce(T.factual(F.col("text")), F.lit(False)).alias("factual"), F.coalesce(T.serious(F.col("text")), F.lit(False)).alias("serious"), F.coalesce(T.several_perspectives(F.col("text")), F.lit(False)).alias("several"))
    gates = gates.withColumn("mode", F.when(F.col("factual"), "none").when(F.col("serious"), "check").when(F.col("several"), "perspective").otherwise("general"))
    scored = fused.withColumn("score", N.rounded(N.fallback_score(F.col("rank") - 1)))
    out = gates.join(scored, "query_id", "left").where("mode <> 'none' or rank is null or rank = 1")
    none = F.col("mode") == "none"
    return out.select("query_id", "mode", *[F.when(~none, F.col(x)).alias(x) for x in ("id", "rank", "rrf", "score")])


RECOMMEND_SQL = f"""
WITH cm AS {COMMENTS_SQL}, ct AS (SELECT DISTINCT id, name, message, relational_pattern, example_context FROM catalogue),
  dm AS (SELECT id, concat_ws(' ', name, message, relational_pattern) AS text FROM ct), de AS (SELECT id, example_context AS text FROM ct),
  {bm25_sql("cm", "dm", 30, "_m")}, {bm25_sql("cm", "de", 30, "_e")},
  f AS ({_fuse_sql("SELECT * FROM ranked_m UNION ALL SELECT * FROM ranked_e", 5)}),
  g AS (SELECT query_id, CASE WHEN regexp_matches(text, {sql_text(P.FACTUAL_REQUEST)}) AND regexp_matches(text, {sql_text(P.FACTUAL_DOMAIN)}) THEN 'none'
    WHEN regexp_matches(text, {sql_text(P.HELP_SEEKING)}) OR regexp_matches(text, {sql_text(P.HIGH_RISK)}) OR regexp_matches(text, {sql_text(P.SUPPORT_REQUEST)}) OR regexp_matches(text, {sql_text(P.SERIOUS_TOPIC)}) THEN 'check'
    WHEN regexp_matches(o, {sql_text(P.NARRATOR)}) AND (regexp_matches(o, {sql_text(P.DIRECT_PRONOUN)}) OR regexp_matches(o, {sql_text(P.AGENTIVE_THEY)}) OR regexp_matches(o, {sql_text(P.AGENTIVE_THEM)}) OR regexp_matches(o, {sql_text(P.OBSERVED_ACTION)}) OR regexp_matches(o, {sql_text(P.ROLE)})) THEN 'perspective'
    ELSE 'general' END AS mode FROM (SELECT query_id, text, regexp_replace(text, {sql_text(P.QUOTED)}, ' ', 'g') AS o FROM cm))
SELECT query_id, mode, CASE WHEN mode <> 'none' THEN id END AS id, CASE WHEN mode <> 'none' THEN rank END AS rank, CASE WHEN mode <> 'none' THEN rrf END AS rrf,
  CASE WHEN mode <> 'none' THEN {r6("greatest(0.25::DOUBLE, 0.49::DOUBLE - 0.04::DOUBLE * (rank - 1))")} END AS score
FROM g LEFT JOIN f USING (query_id) WHERE mode <> 'none' OR rank IS NULL OR rank = 1"""


def text_gates(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return t(spark, d, "documents").where("text is not null").select("doc_id", T.serious(x).alias("serious"), T.factual(x).alias("factual"), T.several_perspectives(x).alias("several"), T.first_category(x, "other").alias("category"))


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {sql_text(p)}) THEN '{n}'" for n, p in P.CATEGORIES) + " ELSE 'other' END"
GATES_SQL = f"""
SELECT doc_id,
  regexp_matches(text, {sql_text(P.HELP_SEEKING)}) OR regexp_matches(text, {sql_text(P.HIGH_RISK)}) OR regexp_matches(text, {sql_text(P.SUPPORT_REQUEST)}) OR regexp_matches(text, {sql_text(P.SERIOUS_TOPIC)}) AS serious,
  regexp_matches(text, {sql_text(P.FACTUAL_REQUEST)}) AND regexp_matches(text, {sql_text(P.FACTUAL_DOMAIN)}) AS factual,
  regexp_matches(o, {sql_text(P.NARRATOR)}) AND (regexp_matches(o, {sql_text(P.DIRECT_PRONOUN)}) OR regexp_matches(o, {sql_text(P.AGENTIVE_THEY)}) OR regexp_matches(o, {sql_text(P.AGENTIVE_THEM)}) OR regexp_matches(o, {sql_text(P.OBSERVED_ACTION)}) OR regexp_matches(o, {sql_text(P.ROLE)})) AS several,
  {_CATEGORY_SQL} AS category
FROM (SELECT doc_id, text, regexp_replace(text, {sql_text(P.QUOTED)}, ' ', 'g') AS o FROM documents WHERE text IS NOT NULL)"""


def score_repair(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, (F.floor("o_totalprice") % 130).cast("int")).alias("p"))
    return K.descending_scores(o, "o_custkey", "o_orderkey", "p").select("o_custkey", "o_orderkey", "repaired")


SCORE_REPAIR_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) % 130 AS INT) END AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
  f AS (SELECT o_custkey, o_orderkey, i, greatest(0, least(100, coalesce(p, 60))) AS s FROM o WHERE i = 1
    UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, greatest(0, least(100, coalesce(o.p, 60), f.s - 1)) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)
SELECT o_custkey, o_orderkey, CAST(s AS INT) AS repaired FROM f"""


def close_call_rerank(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_orderkey", "id", "l_discount", "l_quantity")
    r = K.close_calls(li, "l_orderkey", "id", "l_discount", "l_quantity", "id", 5, 0.025)
    return r.select("l_orderkey", "id", "head_no", "rank")


CLOSE_SQL = f"""
WITH RECURSIVE o AS (SELECT * FROM (SELECT l_orderkey, id, l_discount AS s, l_quantity AS prior, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, id) AS i FROM {LINES_SQL}) WHERE i <= 5),
  f AS (SELECT l_orderkey, id, i, prior, s AS head, 1 AS head_no FROM o WHERE i = 1
    UNION ALL SELECT o.l_orderkey, o.id, o.i, o.prior, CASE WHEN f.head - o.s > 0.025::DOUBLE THEN o.s ELSE f.head END, CASE WHEN f.head - o.s > 0.025::DOUBLE THEN f.head_no + 1 ELSE f.head_no END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1)
SELECT l_orderkey, id, head_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY head_no, prior DESC, i) AS INT) AS rank FROM f"""


def ordinal_expected_score(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", N.softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 5), 18.0).alias("p"))
    return e.select("vec_id", N.rounded(N.expected_level(F.col("p"))).alias("score"), N.likeliest_level(F.col("p")).alias("level"))


ORDINAL_SQL = f"""
WITH x AS (SELECT vec_id, CAST(embedding[1:5] AS DOUBLE[]) AS a FROM embeddings), e AS (SELECT vec_id, list_transform(a, lambda v: exp((v - list_max(a)) * 18)) AS e FROM x),
  p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT vec_id, {r6("(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / 4")} AS score, CAST(list_position(p, list_max(p)) - 1 AS INT) AS level FROM p"""


def selection_shape(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_orderkey", "id", (F.col("l_quantity") / 50).alias("s"))
    ranked = K.ordinal_rank(li, "l_orderkey", "id", "s", "id", 5)
    return K.shaped(ranked, "l_orderkey", "s", 0.6).select("l_orderkey", "id", "rank", "percent", "label", "confidence")


SHAPE_SQL = f"""
WITH x AS (SELECT l_orderkey, id, l_quantity / 50 AS s FROM {LINES_SQL}),
  f AS (SELECT *, min(s) OVER w = max(s) OVER w AND count(*) OVER w > 1 AS flat FROM x WINDOW w AS (PARTITION BY l_orderkey)),
  r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, id) AS INT) AS rank FROM f WHERE NOT flat) WHERE rank <= 5),
  k AS (SELECT * FROM r WHERE rank = 1 OR s >= 0.6::DOUBLE), b AS (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS best FROM k)
SELECT l_orderkey, id, rank, CAST(floor(s * 100 + 0.5) AS INT) AS percent, CASE WHEN s >= 0.9::DOUBLE THEN 'exact' WHEN s >= 0.75::DOUBLE THEN 'strong' WHEN s >= 0.6::DOUBLE THEN 'plausible' ELSE 'weak' END AS label,
  CASE WHEN best >= 0.9::DOUBLE THEN 'high' WHEN best >= 0.75::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM b"""


def perspective_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Per query vector, its 12 nearest as candidates with three lenses; the exact fold."""
    q, c = _vectors(spark, d)
    near = R.nearest(q, c, 12).withColumnRenamed("rank", "retrieval_rank")
    v = c.select("id", *[((F.col("v")[i] + 1) / 2).alias(n) for i, n in enumerate(("self", "other", "situation"))])
    return K.perspectives(near.drop("score").join(v, "id"), ["self", "other", "situation"])


def pairwise_balanced(spark: SparkSession, d: str) -> DataFrame:
    li = lines(spark, d).select("l_orderkey", "id", "l_extendedprice")
    a, b = li.toDF("query_id", "a", "x"), li.toDF("query_id", "b", "y")
    pairs = a.join(b, "query_id").where("a <> b").select("query_id", "a", "b", (F.col("x") / (F.col("x") + F.col("y"))).alias("p"))
    return K.balanced_scores(pairs).select("query_id", "id", N.rounded(F.col("score")).alias("score"))


BALANCED_SQL = f"SELECT a.l_orderkey AS query_id, a.id AS id, {r6('avg((a.l_extendedprice / (a.l_extendedprice + b.l_extendedprice) + 1 - b.l_extendedprice / (a.l_extendedprice + b.l_extendedprice)) / 2) * 100')} AS score FROM {LINES_SQL} a JOIN {LINES_SQL} b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id GROUP BY 1, 2"


def cosine_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Each odd-labelled vector's nearest even-labelled one, its uniqueness and a composite score."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    n = R.nearest(e.where("label % 2 = 1").select(F.col("id").alias("query_id"), "v"), e.where("label % 2 = 0"), 1)
    u = N.uniqueness(F.col("score"))
    return n.select(F.col("query_id").alias("vec_id"), F.col("id").alias("neighbour"), "score", N.rounded(u, 3).alias("uniqueness"), N.rounded(0.45 * F.bround(u) + 0.35 * 50 + 0.2 * 100, 3).alias("composite"))


UNIQUE_SQL = f"""
WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, {r6("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))")} AS score FROM embeddings a, embeddings b WHERE a.label % 2 = 1 AND b.label % 2 = 0),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS i FROM s) WHERE i = 1),
  u AS (SELECT *, least(greatest((0.997::DOUBLE - score) / (0.997::DOUBLE - 0.82::DOUBLE) * 100, 0), 100) AS u FROM n)
SELECT vec_id, neighbour, score, floor(u * 1e3 + 0.5) / 1e3 AS uniqueness, floor((0.45::DOUBLE * round_even(u, 0) + 0.35::DOUBLE * 50 + 0.2::DOUBLE * 100) * 1e3 + 0.5) / 1e3 AS composite FROM u"""


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Per query vector, its four nearest with another label, and the target rotated among them."""
    q, c = _vectors(spark, d)
    near = R.nearest(q, c, 30).join(c.select("id", "label"), "id").join(c.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    bad = R.top_k(near.where("label <> own"), ["query_id"], 4, F.col("rank"), rank="n")
    g = bad.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    at = (F.col("query_id") / 50).cast("int") % 5
    at = F.least(at, F.size("ids"))
    return g.select("query_id", F.array_join(F.concat(F.slice("ids", F.lit(1), at), F.array("query_id"), F.slice("ids", at + 1, F.lit(4))), ",").alias("candidates"))


NEGATIVE_SQL = f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS own, c.label, {r6("list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))")} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE label <> own) WHERE n <= 4),
  g AS (SELECT query_id, list(id ORDER BY n) AS ids, least(CAST(query_id / 50 AS INT) % 5, count(*)) AS pos FROM b GROUP BY query_id)
SELECT query_id, array_to_string(list_concat(list_concat(ids[1:pos], [query_id]), ids[pos + 1:4]), ',') AS candidates FROM g"""


def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    """30 records of different tags from the best by uniqueness, then strength; greedy, so checked by rows."""
    c = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "categories", "meme_strength", "asset_quality", "uniqueness_score")
    scored = c.withColumn("s", N.finite_or(F.col("meme_strength"), 50) * 0.45 + N.finite_or(F.col("asset_quality"), 50) * 0.35 + N.finite_or(F.col("uniqueness_score"), 50) * 0.2)
    ids = K.diverse(scored, "proposed_id", "categories", "s", 30)
    return spark.createDataFrame(pd.DataFrame({"place": range(1, len(ids) + 1), "proposed_id": ids}), "place int, proposed_id string")


QUERIES = {f.__name__: f for f in (bm25_top3, vector_topk_dual_view, rrf_fusion, reserve_merge, recommend_batch, text_gates, score_repair, close_call_rerank, ordinal_expected_score, selection_shape, perspective_assignment, pairwise_balanced, cosine_uniqueness, hard_negatives, diverse_selection)}
SQL = {
    "bm25_top3": BM25_SQL,
    "vector_topk_dual_view": f"SELECT query_id, list, id, score, rank FROM ({_view_sql()})",
    "rrf_fusion": _fuse_sql(_view_sql()),
    "reserve_merge": RESERVE_SQL,
    "recommend_batch": RECOMMEND_SQL,
    "text_gates": GATES_SQL,
    "score_repair": SCORE_REPAIR_SQL,
    "close_call_rerank": CLOSE_SQL,
    "ordinal_expected_score": ORDINAL_SQL,
    "selection_shape": SHAPE_SQL,
    "pairwise_balanced": BALANCED_SQL,
    "cosine_uniqueness": UNIQUE_SQL,
    "hard_negatives": NEGATIVE_SQL,
}
