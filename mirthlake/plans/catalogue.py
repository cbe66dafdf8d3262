"""Queries: audit, deduplication, catalogue building and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as T
from ..operators import audit as A
from ..operators import catalogue as C
from ..operators import dedup as D
from ..operators import quality as Q
from ..operators import similarity as S
from .common import once, r6, sql_list, sql_text, t

NAME_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _names(spark, d):
    """Records of the catalogue as references and of the replacements as targets, with places."""
    c = once(spark, d, "catalogue", "id", "name").select("id", "name", F.lit("reference").alias("scope"))
    r = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "name").select(F.col("proposed_id").alias("id"), "name", F.lit("target").alias("scope"))
    return c.unionByName(r).withColumn("pos", F.xxhash64("id"))


def key_conflicts_name(spark: SparkSession, d: str) -> DataFrame:
    """How many records of either table share each loose name, for names that conflict."""
    n = _names(spark, d).withColumn("k", T.loose_key(T.simple_name(F.col("name"))))
    g = n.where("k is not null").groupBy("k").agg(F.count_if(F.col("scope") == "reference").alias("n_references"), F.count_if(F.col("scope") == "target").alias("n_targets"))
    return g.where("n_targets > 0 and n_references + n_targets > 1")


KEY_SQL = f"""
WITH n AS (SELECT DISTINCT id, name, 'reference' AS scope FROM catalogue UNION ALL SELECT DISTINCT proposed_id, name, 'target' FROM stage_3000_reaction_gif_replacements),
  k AS (SELECT scope, array_to_string(list_sort(list_distinct(list_filter(string_split({NAME_SQL.format("name")}, ' '), lambda w: w <> '' AND NOT list_contains({sql_list(P.BOILERPLATE)}, w)))), ' ') AS k FROM n)
SELECT k, count(*) FILTER (WHERE scope = 'reference') AS n_references, count(*) FILTER (WHERE scope = 'target') AS n_targets FROM k WHERE k <> '' GROUP BY k HAVING count(*) FILTER (WHERE scope = 'target') > 0 AND count(*) > 1"""


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Image addresses in one form, their first spelling and the tables they come from."""
    a = once(spark, d, "catalogue", "id", "image_url").select(F.concat(F.lit("catalogue|"), "id").alias("pos"), "image_url", F.lit("catalogue").alias("source"))
    b = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "image_url").select(F.concat(F.lit("replacements|"), "proposed_id").alias("pos"), "image_url", F.lit("replacements").alias("source"))
    u = D.distinct_urls(a.unionByName(b).where("image_url is not null"), "image_url", T.canonical_url(F.col("image_url"), image=True), "source", "pos")
    return u.select("canonical_url", "first_url", F.array_join("sources", ",").alias("sources"), "n_rows")


URL_SQL = r"""
WITH u AS (SELECT DISTINCT 'catalogue|' || id AS pos, trim(image_url) AS image_url, 'catalogue' AS source FROM catalogue WHERE image_url IS NOT NULL UNION ALL SELECT DISTINCT 'replacements|' || proposed_id, trim(image_url), 'replacements' FROM stage_3000_reaction_gif_replacements WHERE image_url IS NOT NULL),
  p AS (SELECT *, regexp_replace(image_url, '#.*$', '') AS x FROM u),
  q AS (SELECT *, lower(regexp_extract(x, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(x, '^[A-Za-z]+://([^/?:]+)', 1)), '^www\.', '') AS host, regexp_extract(x, '^[A-Za-z]+://[^/?:]+:(\d+)', 1) AS port,
    regexp_replace(regexp_replace(regexp_extract(x, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(x, '\?(.*)$', 1), '&'), lambda k: k <> '' AND NOT regexp_matches(k, '(?i)^(?:utm_[^=]*|fbclid|gclid|format|h|height|q|quality|w|width)(?:=|$)'))) AS kept FROM p),
  c AS (SELECT *, CASE WHEN scheme = '' THEN image_url ELSE scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url FROM q)
SELECT canonical_url, arg_min(image_url, (pos, image_url)) AS first_url, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n_rows FROM c WHERE canonical_url <> '' GROUP BY canonical_url"""


def near_semantic_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of catalogue records whose message and pattern share 82 % of their words or more."""
    c = once(spark, d, "catalogue", "id", "message", "relational_pattern")
    x = c.select(F.col("id").alias("pos"), T.semantic_tokens(T.simple_name(F.concat_ws(" ", "message", "relational_pattern"))).alias("tokens"))
    return S.set_join(x, "tokens", 0.82, least=4)


SEMANTIC_SQL = f"""
WITH c AS (SELECT DISTINCT id, concat_ws(' ', message, relational_pattern) AS x FROM catalogue),
  s AS (SELECT id, list_distinct(list_filter(string_split({NAME_SQL.format("x")}, ' '), lambda w: length(w) > 2 AND NOT list_contains({sql_list(P.SEMANTIC_STOP)}, w))) AS ws FROM c),
  k AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM s WHERE len(ws) >= 4),
  p AS (SELECT a.id AS pos_a, b.id AS pos_b, any_value(a.n) AS size_a, any_value(b.n) AS size_b, count(*) AS shared FROM k a JOIN k b ON a.w = b.w AND a.id < b.id GROUP BY ALL HAVING count(*) > 3)
SELECT pos_a, pos_b, CAST(shared AS INT) AS shared, CAST(size_a AS INT) AS size_a, CAST(size_b AS INT) AS size_b FROM p WHERE shared >= 0.82::DOUBLE * (size_a + size_b - shared)"""


def _signs() -> Column:
    """The signs of a vector of 64 as a number; null for vectors of another length."""
    return F.when(F.size("embedding") == 64, F.aggregate("embedding", F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0)))


def image_signs(spark: SparkSession, d: str) -> DataFrame:
    """(pos, bits): each image and the signs of its vector. Signs are taken before redelivered rows become one, so vectors aren't shuffled."""
    s = t(spark, d, "stage_3000_local_signals").select(F.col("id").alias("pos"), _signs().alias("bits"), "ingested_at")
    return D.latest(s, ["pos"], "ingested_at", "pos").where("bits is not null").select("pos", "bits")


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Images whose vectors' 64 signs differ in five places at most."""
    return S.bit_join(image_signs(spark, d), "bits", 5)


HAMMING_SQL = """
WITH s AS (SELECT DISTINCT id, list_transform(embedding, lambda x: coalesce(x > 0, FALSE)) AS b FROM stage_3000_local_signals WHERE len(embedding) = 64)
SELECT a.id AS pos_a, b.id AS pos_b, CAST(len(list_filter(list_zip(a.b, b.b), lambda z: z[1] <> z[2])) AS INT) AS distance FROM s a JOIN s b ON a.id < b.id WHERE len(list_filter(list_zip(a.b, b.b), lambda z: z[1] <> z[2])) <= 5"""


def exact_content_dups(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same text: one row a text, by hash."""
    x = t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return x.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def uniqueness_audit(spark: SparkSession, d: str) -> DataFrame:
    """All nine kinds of conflict between and within catalogue (references) and replacements (targets) by kind, and the records blocked or to be reviewed."""
    c = once(spark, d, "catalogue", "id", "name", "image_url", "message", "relational_pattern").select("id", F.lit("reference").alias("scope"), "name", F.lit(None).cast("array<string>").alias("aliases"), F.lit("catalogue").alias("provider"), F.col("id").alias("source_id"), "image_url", "message", "relational_pattern")
    r = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "name", "provider", "source_id", "image_url", "assistive_text").select(F.col("proposed_id").alias("id"), F.lit("target").alias("scope"), "name", F.lit(None).cast("array<string>").alias("aliases"), "provider", "source_id", "image_url", F.col("assistive_text").alias("message"), F.lit(None).cast("string").alias("relational_pattern"))
    # what is known of an image's content: the signs of its vector as a perceptual hash, the vector itself as exact content
    # both are taken before redelivered rows become one, so vectors aren't shuffled; null for vectors of another length
    whole = F.when(F.size("embedding") == 64, F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    e = t(spark, d, "stage_3000_local_signals").select("id", whole.alias("sha256"), F.lower(F.lpad(F.hex(_signs()), 16, "0")).alias("phash"), "ingested_at")
    e = D.latest(e, ["id"], "ingested_at", "id").drop("ingested_at")
    all_ = c.unionByName(r).join(e, "id", "left").withColumn("pos", F.xxhash64("id")).withColumn("dhash", F.lit(None).cast("string"))
    found, status = A.audit(all_)
    pairs = found.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("left_id").alias("n_left"), F.count_distinct("right_id").alias("n_right"))
    none = F.lit(None).cast("bigint")
    return pairs.unionByName(status.groupBy(F.lit("records").alias("kind"), F.col("status").alias("severity")).agg(F.count("*").alias("n"), none.alias("n_left"), none.alias("n_right")))


def name_decollision(spark: SparkSession, d: str) -> DataFrame:
    """Names made unique by numbers, within parts of one size."""
    p = t(spark, d, "part").withColumn("base", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    return D.numbered_names(p, "base", "p_partkey").select("p_partkey", "unique_name")


def suffix_on_collision(spark: SparkSession, d: str) -> DataFrame:
    c = once(spark, d, "catalogue", "id", "name", "message").where("message is not null")
    return D.suffixed(c, "message", "name", "id").select("id", "distinct_text")


SUFFIX_SQL = r"SELECT id, CASE WHEN i = 1 THEN message ELSE regexp_replace(message, '[.!?]+$', '') || ' (' || name || ').' END AS distinct_text FROM (SELECT *, row_number() OVER (PARTITION BY lower(message) ORDER BY id) AS i FROM (SELECT DISTINCT id, name, message FROM catalogue WHERE message IS NOT NULL))"


def first_of_either_key(spark: SparkSession, d: str) -> DataFrame:
    """Orders kept when neither their customer and priority, nor their price class and day, was kept before."""
    o = t(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_custkey", "o_orderpriority", "o_orderstatus").alias("a"), F.concat_ws("|", F.floor(F.col("o_totalprice") / 5), F.to_date("o_orderdate")).alias("b"))
    return D.first_of_either(o, "o_orderkey", "a", "b")


def canonical_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each known image the first catalogue record that names it or one of its aliases."""
    items = t(spark, d, "canonical_memes").select(F.col("id").alias("item_id"), F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.simple_name).alias("aliases"))
    c = once(spark, d, "catalogue", "id", "name", "message", "relational_pattern", "tags")
    r = c.select("id", F.col("id").alias("pos"), T.simple_name(F.concat_ws(" ", "id", "name", "message", "relational_pattern", F.array_join("tags", " "))).alias("text"))
    return S.covered_by_alias(items, r)


COVERAGE_SQL = f"""
WITH i AS (SELECT id AS item_id, {NAME_SQL.format("a")} AS a FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS a FROM canonical_memes)),
  c AS (SELECT id, {NAME_SQL.format("concat_ws(' ', id, name, message, relational_pattern, array_to_string(tags, ' '))")} AS x FROM (SELECT DISTINCT id, name, message, relational_pattern, tags FROM catalogue))
SELECT m.id AS item_id, min(c.id) AS record_id FROM canonical_memes m LEFT JOIN (i JOIN c ON i.a <> '' AND contains(c.x, i.a)) ON i.item_id = m.id GROUP BY m.id"""


def filter_with_reason(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first rule that leaves them out."""
    rules = [("no_text", F.length(F.trim("text")) > 0), ("no_language", F.col("lang").isin("en", "de", "es", "fr")), ("too_short", F.col("n_chars") >= 40), ("sensitive", ~F.col("text").rlike(P.SENSITIVE)), ("says_nothing", ~F.col("text").rlike(P.UNHELPFUL_TITLE))]
    x = t(spark, d, "documents").withColumn("reason", F.coalesce(Q.first_reason(rules), F.lit("kept")))
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


REASON_SQL = f"""
SELECT reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN NOT coalesce(length(trim(text)) > 0, FALSE) THEN 'no_text' WHEN NOT coalesce(lang IN ('en', 'de', 'es', 'fr'), FALSE) THEN 'no_language' WHEN NOT n_chars >= 40 THEN 'too_short'
  WHEN regexp_matches(text, {sql_text(P.SENSITIVE)}) THEN 'sensitive' WHEN regexp_matches(text, {sql_text(P.UNHELPFUL_TITLE)}) THEN 'says_nothing' ELSE 'kept' END AS reason FROM documents) GROUP BY reason"""


def usage_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Uses per part, joined with its supplier's nation, in tiers."""
    li = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("uses"))
    x = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    per = x.groupBy("p_brand").agg(F.sum("uses").alias("uses"), F.count_distinct("s_nationkey").alias("n_nations"))
    return per.withColumn("tier", N.use_tier(F.col("uses")))


TIER_SQL = """
SELECT p_brand, CAST(sum(uses) AS BIGINT) AS uses, count(DISTINCT s_nationkey) AS n_nations, CASE WHEN sum(uses) >= 5000 THEN 92 WHEN sum(uses) >= 1000 THEN 86 WHEN sum(uses) >= 500 THEN 82 WHEN sum(uses) >= 250 THEN 78 ELSE 72 END AS tier
FROM (SELECT l_partkey, l_suppkey, count(*) AS uses FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_brand"""


def static_signals(spark: SparkSession, d: str) -> DataFrame:
    """Strength, quality, prior and label of each record, given or inferred."""
    s = once(spark, d, "stage_3000_local_signals", "id", "width", "height", "meme_strength", "asset_quality", "scope")
    strength, quality = N.half_up(N.clamp(N.finite_or(F.col("meme_strength"), 50))), N.half_up(N.clamp(N.finite_or(F.col("asset_quality"), 60)))
    return s.select("id", strength.alias("strength"), quality.alias("quality"), N.static_prior(strength, quality).alias("prior"), N.asset_label(quality).alias("label"), N.rounded(N.resolution_fit(F.col("width"), F.col("height")), 4).alias("resolution"), N.rounded(N.aspect_fit(F.col("width"), F.col("height")), 4).alias("aspect"))


SIGNAL_SQL = """
WITH s AS (SELECT DISTINCT id, width, height, CAST(floor(least(greatest(coalesce(meme_strength, 50), 0), 100) + 0.5) AS INT) AS strength, CAST(floor(least(greatest(coalesce(asset_quality, 60), 0), 100) + 0.5) AS INT) AS quality FROM stage_3000_local_signals)
SELECT id, strength, quality, CAST(floor(strength * 0.7::DOUBLE + quality * 0.3::DOUBLE + 0.5) AS INT) AS prior, CASE WHEN quality >= 86 THEN 'reviewed image' WHEN quality >= 72 THEN 'direct source preview' WHEN quality >= 50 THEN 'source preview needing review' WHEN quality > 0 THEN 'lower-quality source preview' ELSE 'no usable preview' END AS label,
  CASE WHEN width IS NULL OR height IS NULL THEN NULL ELSE floor(least(greatest((log2(least(width, height)) - 7) * 22, 0), 100) * 1e4 + 0.5) / 1e4 END AS resolution,
  CASE WHEN width IS NULL OR height IS NULL THEN NULL ELSE floor(least(greatest(105 - (CAST(greatest(width, height) AS DOUBLE) / least(width, height) - 1) * 28, 0), 100) * 1e4 + 0.5) / 1e4 END AS aspect FROM s"""


def facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by region, by segment, and by both, in one pass."""
    x = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.sql("SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, count(*) AS n, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS balance FROM {x} GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (r_name, c_mktsegment))", x=x)


FACET_SQL = "SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, count(*) AS n, floor(sum(c_acctbal) * 100 + 0.5) / 100 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (r_name, c_mktsegment))"


def substring_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 24 of the records that contain a text, in a shuffled order that never changes."""
    c = once(spark, d, "catalogue", "id", "name", "message", "tags")
    hit = c.where(F.contains(F.lower(F.concat_ws(" ", "name", "message", F.array_join("tags", " "))), F.lit("gasp")))
    return C.page(hit.select("id", "name", F.sha2("id", 256).alias("h")), 1, 24, "h").select("id", "name")


def resume_and_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Customers without orders, pending orders of known customers, and orders of unknown ones, counted."""
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    idle = C.pending(c, o, "c_custkey").agg(F.lit("idle_customers").alias("what"), F.count("*").alias("n"))
    todo = C.pending(o.join(c, "c_custkey", "left_semi"), o.where("o_orderstatus <> 'P'"), "o_orderkey").agg(F.lit("pending_orders").alias("what"), F.count("*").alias("n"))
    unknown = C.pending(o, c.where("c_custkey % 10 <> 3"), "c_custkey").agg(F.lit("unknown_customers").alias("what"), F.count("*").alias("n"))
    return idle.unionByName(todo).unionByName(unknown)


RESUME_SQL = """
SELECT 'idle_customers' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'pending_orders', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'unknown_customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)"""


def override_union(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and replacements in one flat table, the signals' values over the records' own, defaults for the rest."""
    seed = once(spark, d, "stage_300_seed", "id", "name", "media", "provenance").select("id", "name", F.col("media.image_url").alias("image_url"), F.col("provenance.provider").alias("provider"), F.lit(None).cast("bigint").alias("meme_strength"))
    gif = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "name", "image_url", "media_url", "provider", "meme_strength").select(F.col("proposed_id").alias("id"), "name", F.coalesce("image_url", "media_url").alias("image_url"), "provider", "meme_strength")
    signal = once(spark, d, "stage_3000_local_signals", "id", "meme_strength", "asset_quality").withColumn("meme_strength", F.col("meme_strength").cast("bigint"))
    flat = C.overridden(seed.unionByName(gif), signal.select("id", "meme_strength"), "id")
    out = C.with_defaults(flat, signal, "id", {"asset_quality": 50})
    mime = F.when(F.lower("image_url").endswith(".gif"), "image/gif").when(F.lower("image_url").endswith(".png"), "image/png").when(F.lower("image_url").endswith(".jpg"), "image/jpeg")
    return out.select("id", "name", "provider", F.coalesce("meme_strength", F.lit(50).cast("bigint")).alias("meme_strength"), "asset_quality", mime.alias("mime"), T.is_https(F.col("image_url")).alias("https"))


OVERRIDE_SQL = """
WITH f AS (SELECT DISTINCT id, name, media.image_url AS image_url, provenance.provider AS provider, NULL::BIGINT AS own FROM stage_300_seed UNION ALL SELECT DISTINCT proposed_id, name, coalesce(image_url, media_url), provider, meme_strength FROM stage_3000_reaction_gif_replacements),
  s AS (SELECT DISTINCT id, meme_strength, asset_quality FROM stage_3000_local_signals)
SELECT f.id, name, provider, CAST(coalesce(s.meme_strength, own, 50) AS BIGINT) AS meme_strength, coalesce(s.asset_quality, 50) AS asset_quality,
  CASE WHEN lower(image_url) LIKE '%.gif' THEN 'image/gif' WHEN lower(image_url) LIKE '%.png' THEN 'image/png' WHEN lower(image_url) LIKE '%.jpg' THEN 'image/jpeg' END AS mime, coalesce(lower(image_url) LIKE 'https:%', FALSE) AS https FROM f LEFT JOIN s ON s.id = f.id"""


def metadata_repair(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with every text that breaks its rule replaced by its stock form, and tags made usable."""
    s = once(spark, d, "stage_300_seed", "id", "name", "message", "relational_pattern", "example_context", "near_miss_context", "tags")
    s = s.withColumn("t", T.repaired_tags(F.col("tags"), F.lit(None).cast("array<string>")))
    return s.select("id", F.array_join("t", ",").alias("tags"), *[T.repaired_field(k, F.col(k), F.col("name"), F.col("t")).alias(k) for k in ("message", "relational_pattern", "example_context", "near_miss_context")])


_TAG = "trim(regexp_replace(regexp_replace(trim(lower(x)), '[^a-z0-9 -]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _field_sql(kind: str, rule: str, least: int, stock: str) -> str:
    v = f"replace(v_{kind}, '<' || name || '>', name)"
    return f"CASE WHEN {rule.replace('V', v)} AND w_{kind} >= {least} AND NOT regexp_matches({v}, {sql_text(P.PLACEHOLDER)}) THEN {v} ELSE {stock} END AS {kind}"


REPAIR_SQL = f"""
WITH s AS (SELECT DISTINCT ON (id) * FROM stage_300_seed),
  g AS (SELECT *, list_filter(list_transform(coalesce(tags, []), lambda x: {_TAG}), lambda v: v <> '' AND length(v) <= 30 AND len(string_split(v, ' ')) <= 3 AND NOT regexp_matches(v, {sql_text(P.PLACEHOLDER)}) AND NOT list_contains({sql_list(P.TAG_NOISE + P.TAG_DROP)}, v)) AS raw FROM s),
  k AS (SELECT *, list_filter(raw, lambda v, i: list_position(raw, v) = i)[1:6] AS kept FROM g),
  p AS (SELECT *, list_concat(kept, {sql_list(P.TAG_FALLBACK)}) AS more FROM k),
  t AS (SELECT *, CASE WHEN len(kept) >= 3 THEN kept ELSE list_filter(more, lambda v, i: list_position(more, v) = i)[1:3] END AS t FROM p),
  v AS (SELECT *, {", ".join(f"CASE WHEN regexp_replace(trim(coalesce({k}, '')), '[<>]', '', 'g') = '' THEN '' WHEN regexp_matches(regexp_replace(trim({k}), '[<>]', '', 'g'), '[.!?]$') THEN regexp_replace(trim({k}), '[<>]', '', 'g') ELSE regexp_replace(trim({k}), '[<>]', '', 'g') || '.' END AS v_{k}" for k in ("message", "relational_pattern", "example_context", "near_miss_context"))} FROM t),
  w AS (SELECT *, {", ".join(f"len(list_filter(regexp_split_to_array(trim(v_{k}), '\\s+'), lambda x: x <> '')) AS w_{k}" for k in ("message", "relational_pattern", "example_context", "near_miss_context"))} FROM v)
SELECT id, array_to_string(t, ',') AS tags,
  {_field_sql("message", "starts_with(V, 'Use ' || name || ' when')", 10, "'Use ' || name || ' when ' || t[1] || ' collides with ' || t[2] || ', and that mismatch becomes the point of the conversation.'")},
  {_field_sql("relational_pattern", "TRUE", 8, "name || ' frames ' || t[1] || ' against ' || t[2] || ', turning the contrast into a concise social reaction.'")},
  {_field_sql("example_context", "starts_with(V, 'For example,')", 10, "'For example, send ' || name || ' when a conversation moves from ' || t[1] || ' to ' || t[2] || ' and everyone notices the mismatch.'")},
  {_field_sql("near_miss_context", "starts_with(V, 'Avoid')", 10, "'Avoid ' || name || ' when the situation lacks both ' || t[1] || ' and ' || t[2] || '; the image would suggest the wrong relationship.'")}
FROM w"""


def violations_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of catalogue records and evaluation cases, counted."""
    c = once(spark, d, "catalogue", "id", "name", "message", "tags", "image_url")
    rules = [Q.Rule("id_is_slug", F.col("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")), Q.Rule("has_message", T.word_count(F.col("message")) >= 8), Q.Rule("two_tags", F.size(F.coalesce("tags", F.array().cast("array<string>"))) >= 2), Q.Rule("name_is_unique", Q.unique(T.simple_name(F.col("name")))), Q.Rule("image_is_https", T.is_https(F.col("image_url"))), Q.Rule("image_is_unique", Q.unique("image_url"))]
    e = once(spark, d, "relevance_stage3000_fresh_humour", "id", "context", "acceptable_ids", "primary_target_id", "human_validated")
    more = [Q.Rule("context_is_long", F.length("context") >= 30), Q.Rule("has_target", F.size("acceptable_ids") >= 1), Q.Rule("is_validated", F.col("human_validated"))]
    found = Q.violations(c, "id", rules).unionByName(Q.violations(e, "id", more)).unionByName(Q.known(e, "id", "primary_target_id", c, "id", "target_is_known"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


VIOLATION_SQL = f"""
WITH c AS (SELECT DISTINCT ON (id) * FROM catalogue), e AS (SELECT DISTINCT ON (id) * FROM relevance_stage3000_fresh_humour),
  n AS (SELECT *, count(*) OVER (PARTITION BY {NAME_SQL.format("name")}) AS same_name, count(*) OVER (PARTITION BY image_url) AS same_image FROM c),
  v AS (SELECT 'id_is_slug' AS rule FROM c WHERE NOT regexp_matches(id, '^[a-z0-9]+(?:-[a-z0-9]+)*$') UNION ALL SELECT 'has_message' FROM c WHERE len(list_filter(regexp_split_to_array(trim(coalesce(message, '')), '\\s+'), lambda w: w <> '')) < 8
    UNION ALL SELECT 'two_tags' FROM c WHERE coalesce(len(tags), 0) < 2 UNION ALL SELECT 'name_is_unique' FROM n WHERE name IS NOT NULL AND same_name > 1 UNION ALL SELECT 'image_is_https' FROM c WHERE NOT coalesce(lower(image_url) LIKE 'https:%', FALSE) UNION ALL SELECT 'image_is_unique' FROM n WHERE image_url IS NOT NULL AND same_image > 1
    UNION ALL SELECT 'context_is_long' FROM e WHERE NOT coalesce(length(context) >= 30, FALSE) UNION ALL SELECT 'has_target' FROM e WHERE NOT coalesce(len(acceptable_ids) >= 1, FALSE) UNION ALL SELECT 'is_validated' FROM e WHERE NOT coalesce(human_validated, FALSE)
    UNION ALL SELECT 'target_is_known' FROM e WHERE primary_target_id IS NOT NULL AND primary_target_id NOT IN (SELECT id FROM c))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


def provenance_changes(spark: SparkSession, d: str) -> DataFrame:
    """Columns in which seeds differ from what they were made from, nulls equal to nulls."""
    s = once(spark, d, "stage_300_seed", "id", "name", "message", "provenance")
    new = s.select("id", T.title_case(F.lower("name")).alias("name"), T.sentence(F.col("message")).alias("message"), F.col("provenance.provider").alias("provider"))
    old = s.select("id", "name", "message", F.col("provenance.provider").alias("provider"))
    return C.changed(old, new, "id", ["name", "message", "provider"]).groupBy("column").agg(F.count("*").alias("n"))


CHANGE_SQL = r"""
WITH s AS (SELECT DISTINCT id, name, message FROM stage_300_seed),
  t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '\w+|\W+'), lambda x: upper(x[1:1]) || x[2:]), '') AS n2, regexp_replace(trim(coalesce(message, '')), '[<>]', '', 'g') AS m FROM s),
  u AS (SELECT *, CASE WHEN m = '' OR regexp_matches(m, '[.!?]$') THEN m ELSE m || '.' END AS m2 FROM t)
SELECT x AS "column", count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN name IS DISTINCT FROM n2 THEN 'name' END, CASE WHEN message IS DISTINCT FROM m2 THEN 'message' END], lambda y: y IS NOT NULL)) AS x FROM u) GROUP BY x"""


def two_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each seed image's record by exact address, else by canonical address."""
    s = once(spark, d, "stage_300_seed", "id", "media").select("id", F.col("media.image_url").alias("exact")).where("exact is not null").withColumn("exact", F.concat("exact", F.when(F.length("id") % 2 == 0, "?utm_source=x").otherwise(""))).withColumn("canonical", T.canonical_url(F.col("exact")))
    table = once(spark, d, "stage_300_seed", "id", "media").unionByName(once(spark, d, "catalogue", "id", "image_url").select("id", F.struct(F.col("image_url"), F.lit(None).cast("string").alias("rights_status")).alias("media"))).select(F.col("media.image_url").alias("exact"), T.canonical_url(F.col("media.image_url")).alias("canonical"), F.col("id").alias("record_id"), F.col("id").alias("pos")).where("exact is not null")
    return C.two_tier(s, table, "exact", "canonical", "record_id", "pos").select("id", "record_id")


TWO_TIER_SQL = """
WITH s AS (SELECT DISTINCT id, media.image_url AS raw FROM stage_300_seed WHERE media.image_url IS NOT NULL), c AS (SELECT DISTINCT id, image_url AS raw FROM catalogue WHERE image_url IS NOT NULL),
  u AS (SELECT 's' AS side, id, raw || CASE WHEN length(id) % 2 = 0 THEN '?utm_source=x' ELSE '' END AS image_url FROM s UNION ALL SELECT 't', id, raw FROM s UNION ALL SELECT 't', id, raw FROM c),
""" + URL_SQL[URL_SQL.index("  p AS (SELECT *, regexp_replace(image_url") : URL_SQL.index("SELECT canonical_url, arg_min")].replace("c AS (SELECT *, CASE", "k AS (SELECT *, CASE") + """,
  e AS (SELECT image_url, max(id) AS record_id FROM k WHERE side = 't' GROUP BY image_url), f AS (SELECT canonical_url, min(id) AS record_id FROM k WHERE side = 't' GROUP BY canonical_url)
SELECT k.id, coalesce(e.record_id, f.record_id) AS record_id FROM k LEFT JOIN e USING (image_url) LEFT JOIN f USING (canonical_url) WHERE side = 's'"""


def dataset_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the sorted catalogue ids joined by line breaks, and their number."""
    from ..operators.metrics import id_hash

    return id_hash(once(spark, d, "catalogue", "id"), "id")


HASH_SQL = "SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS hash, count(*) AS n FROM (SELECT DISTINCT id FROM catalogue)"


def entity_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with entities decoded and in plain form, by hash; and as a URL part."""
    x = t(spark, d, "documents").where("text is not null").select("doc_id", T.full_name(F.col("text")).alias("plain"))
    return x.select("doc_id", F.sha2("plain", 256).alias("plain_sha"), T.slug(F.col("plain"), 72).alias("slug"), F.size(T.lexical_tokens(F.col("plain"))).alias("n_tokens"))


def semantic_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of each record, explanations repaired, and whether they are complete."""
    c = once(spark, d, "catalogue", "id", "name", "message", "relational_pattern", "example_context", "tags")
    why = T.repaired_explanation(F.coalesce("relational_pattern", F.lit("")), F.col("name"))
    return c.select("id", T.semantic_text(F.col("name"), F.col("message"), F.col("relational_pattern"), F.col("tags")).alias("meaning"), T.example_text(F.col("name"), F.col("example_context"), F.col("relational_pattern")).alias("example"), why.alias("explanation"), T.complete_explanation(why, F.col("name")).alias("complete"), T.html_escape(F.coalesce("message", F.lit(""))).alias("escaped"))


_COMP = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_COUNT = r"len(list_filter(regexp_split_to_array(trim({}), '\s+'), lambda w: w <> ''))"
TEXT_SQL = f"""
WITH c AS (SELECT *, trim(coalesce(relational_pattern, '')) AS r, list_filter(coalesce(tags, []), lambda t: trim(lower(t)) <> '' AND NOT list_contains({sql_list(P.GENERIC_TAGS)}, trim(lower(t))) AND NOT list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), trim(lower(t)))) AS kept FROM (SELECT DISTINCT ON (id) * FROM catalogue)),
  n AS (SELECT *, CASE WHEN NOT contains({_COMP.format("r")}, {_COMP.format("name")}) THEN name || ' fits because ' || lower(regexp_replace(r, '[.!?]+$', '')[1:1]) || regexp_replace(r, '[.!?]+$', '')[2:] ELSE r END AS named FROM c),
  e AS (SELECT *, CASE WHEN regexp_matches(named, '[.!?]$') THEN named ELSE named || '.' END AS ended FROM n),
  x AS (SELECT *, CASE WHEN r = '' OR name IS NULL THEN r WHEN {_COUNT.format("ended")} < 8 THEN regexp_replace(ended, '[.!?]+$', '') || ', matching this specific social situation.' ELSE ended END AS explanation FROM e)
SELECT id, concat_ws(chr(10), 'Meme: ' || name, 'Meaning: ' || message, 'Social dynamic: ' || relational_pattern, CASE WHEN len(kept) > 0 THEN 'Tags: ' || array_to_string(kept, ', ') END) AS meaning,
  concat_ws(chr(10), 'Meme: ' || name, 'Send it when: ' || example_context, 'Underlying pattern: ' || relational_pattern) AS example, explanation,
  coalesce({_COUNT.format("explanation")} BETWEEN 8 AND 40 AND NOT regexp_matches(trim(explanation), {sql_text(P.GENERIC_EXPLANATION)}) AND regexp_matches(trim(explanation), '^[A-Z0-9]') AND regexp_matches(trim(explanation), '[.!?]$') AND contains({_COMP.format("trim(explanation)")}, {_COMP.format("name")}), FALSE) AS complete,
  replace(replace(replace(replace(replace(coalesce(message, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM x"""


def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested columns to text and back, and their parts; captions cleaned."""
    r = once(spark, d, "stage_3000_reaction_gif_replacements", "proposed_id", "usage_evidence", "assistive_text", "categories", "selection_rank")
    j = F.to_json(F.struct("usage_evidence.kind", "usage_evidence.conversation_uses", "selection_rank"))
    back = F.from_json(j, "kind string, conversation_uses bigint, selection_rank bigint")
    return r.select("proposed_id", back["conversation_uses"].alias("uses"), back["kind"].alias("kind"), T.clean_caption(F.col("assistive_text")).alias("caption"), F.lpad(back["selection_rank"].cast("string"), 6, "0").alias("place"), N.use_tier(back["conversation_uses"]).alias("tier"))


JSON_SQL = r"""
SELECT proposed_id, usage_evidence.conversation_uses AS uses, usage_evidence.kind AS kind, substr(trim(regexp_replace(regexp_replace(replace(assistive_text, '[INTER_FRAME_SEP]', ' '), '\s+', ' ', 'g'), '^[-_.,:;]+|[-_.,:;]+$', '', 'g')), 1, 400) AS caption, lpad(CAST(selection_rank AS VARCHAR), 6, '0') AS place,
  CASE WHEN usage_evidence.conversation_uses IS NULL THEN 95 WHEN usage_evidence.conversation_uses >= 5000 THEN 92 WHEN usage_evidence.conversation_uses >= 1000 THEN 86 WHEN usage_evidence.conversation_uses >= 500 THEN 82 WHEN usage_evidence.conversation_uses >= 250 THEN 78 ELSE 72 END AS tier
FROM (SELECT DISTINCT ON (proposed_id) * FROM stage_3000_reaction_gif_replacements)"""


def leakage_exact(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases whose plain text is that of a catalogue example."""
    e = once(spark, d, "smoke_cases", "id", "context").select("id", T.simple_name(F.col("context")).alias("k")).where("k <> ''")
    k = once(spark, d, "catalogue", "id", "example_context").select(T.simple_name(F.col("example_context")).alias("k")).where("k <> ''").distinct()
    per = e.groupBy("k").agg(F.count("*").alias("n")).join(k.withColumn("known", F.lit(True)), "k", "left")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(some(F.lit(True)).alias("n_cases"), some(F.col("n") > 1).alias("n_repeated"), some(F.col("known").isNotNull()).alias("n_leaked"))


LEAK_SQL = f"""
WITH e AS (SELECT id, {NAME_SQL.format("context")} AS k FROM (SELECT DISTINCT id, context FROM smoke_cases)), f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM e WHERE k <> '')
SELECT count(*) AS n_cases, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE k IN (SELECT {NAME_SQL.format("example_context")} FROM catalogue WHERE example_context IS NOT NULL)) AS n_leaked FROM f"""

QUERIES = {f.__name__: f for f in (key_conflicts_name, canonical_urls, near_semantic_metadata, hamming_pairs, exact_content_dups, uniqueness_audit, name_decollision, suffix_on_collision, first_of_either_key, canonical_coverage, filter_with_reason, usage_tiers, static_signals, facets, substring_page, resume_and_unknown, override_union, metadata_repair, violations_report, provenance_changes, two_tier_lookup, dataset_hash, entity_normalise, semantic_texts, metadata_json, leakage_exact)}
SQL = {
    "key_conflicts_name": KEY_SQL,
    "canonical_urls": URL_SQL,
    "near_semantic_metadata": SEMANTIC_SQL,
    "hamming_pairs": HAMMING_SQL,
    "exact_content_dups": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "name_decollision": "SELECT p_partkey, CASE WHEN i = 1 THEN b ELSE b || ' Reaction ' || i END AS unique_name FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS i FROM (SELECT p_partkey, p_name || ' ' || p_size AS b FROM part))",
    "suffix_on_collision": SUFFIX_SQL,
    "canonical_coverage": COVERAGE_SQL,
    "filter_with_reason": REASON_SQL,
    "usage_tiers": TIER_SQL,
    "static_signals": SIGNAL_SQL,
    "facets": FACET_SQL,
    "substring_page": "WITH h AS (SELECT id, name, row_number() OVER (ORDER BY sha256(id)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id, name, message, tags FROM catalogue) WHERE contains(lower(concat_ws(' ', name, message, array_to_string(tags, ' '))), 'gasp')) SELECT id, name FROM h WHERE i // 24 = least(1, (n - 1) // 24)",
    "resume_and_unknown": RESUME_SQL,
    "override_union": OVERRIDE_SQL,
    "metadata_repair": REPAIR_SQL,
    "violations_report": VIOLATION_SQL,
    "provenance_changes": CHANGE_SQL,
    "two_tier_lookup": TWO_TIER_SQL,
    "dataset_hash": HASH_SQL,
    "semantic_texts": TEXT_SQL,
    "metadata_json": JSON_SQL,
    "leakage_exact": LEAK_SQL,
}
