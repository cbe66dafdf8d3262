"""The uniqueness audit: nine kinds of conflicts in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import numeric as N
from ..functions import text as T
from .dedup import concerned
from .similarity import bit_join, set_join, shared_key

BLOCKING = ["provider_source_id", "exact_image_url", "canonical_image_url", "normalized_name", "exact_semantic_metadata", "exact_image_content"]


def conflicts(records: DataFrame, near: float = 0.82, perceptual: float = 0.08) -> DataFrame:
    """(kind, left_id, left_scope, right_id, right_scope, key, metric, severity).

    records: pos BIGINT, id, scope ('reference', 'target'), name STRING, aliases ARRAY<STRING>, provider, source_id,
    image_url, message, relational_pattern, sha256, phash, dhash STRING. Pairs of references aren't reported, a pair
    once a kind. Null and empty keys conflict with nothing.
    """
    names = F.transform(T.strict_keys(F.col("name"), F.col("aliases")), lambda x: x)
    r = records.withColumn("_names", names).withColumn("_row", F.col("pos"))
    flat = r.select("pos", F.explode_outer("_names").alias("n")).withColumn("n", T.full_name(F.col("n"))).groupBy("pos").agg(F.collect_set(F.when(F.col("n") != "", F.col("n"))).alias("strict"))
    flat = flat.withColumn("loose", F.transform("strict", lambda x: T.loose_key(x)))
    whole = ["pos", "id", "scope", "provider", "source_id", "image_url", "sha256", "phash", "dhash"]
    sem = r.select(*whole, T.full_name(F.col("message")).alias("m"), T.full_name(F.col("relational_pattern")).alias("p"))
    sem = sem.select(*whole, F.when((F.col("m") != "") | (F.col("p") != ""), F.concat("m", F.lit("|"), "p")).alias("signature"), T.semantic_tokens(F.concat_ws(" ", "m", "p")).alias("tokens"))
    # names, signatures and tokens are made once and read by every kind; the texts they are made of stay behind
    r = sem.join(flat, "pos").persist(StorageLevel.DISK_ONLY)
    keyed = [
        ("provider_source_id", F.array(F.when(F.col("source_id") != "", F.concat(F.lower("provider"), F.lit(":"), F.lower("source_id"))))),
        ("exact_image_url", F.array(F.trim("image_url"))),
        ("canonical_image_url", F.array(T.canonical_url(F.col("image_url"), image=True))),
        ("normalized_name", F.col("strict")),
        ("alias_name", F.col("loose")),
        ("exact_semantic_metadata", F.array(F.col("signature"))),
    ]
    out = None
    for kind, keys in keyed:
        one = shared_key(r.withColumn("_k", keys), "_k", kind)
        out = one if out is None else out.unionByName(one)
    side = r.select("pos", "id", "scope", "signature", "sha256", "phash", "dhash")
    a, b = [side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "ab"]

    def pairs(p: DataFrame, kind: str, metric) -> DataFrame:
        p = p.where("scope_a = 'target' or scope_b = 'target'")
        return p.select(F.lit(kind).alias("kind"), F.col("id_a").alias("left_id"), F.col("scope_a").alias("left_scope"), F.col("id_b").alias("right_id"), F.col("scope_b").alias("right_scope"), F.lit(None).cast("string").alias("key"), metric.alias("metric"))

    sets = set_join(r, "tokens", near, least=4).join(a, "pos_a").join(b, "pos_b").where("not (signature_a <=> signature_b)")
    shared = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    out = out.unionByName(pairs(sets, "near_semantic_metadata", F.round(shared, 4)))
    same = a.where("sha256_a is not null").join(b, (F.col("sha256_a") == F.col("sha256_b")) & (F.col("pos_a") < F.col("pos_b")))
    out = out.unionByName(pairs(same, "exact_image_content", F.lit(0.0)))
    bits = bit_join(r.withColumn("_b", N.hex_bits(F.coalesce("phash", "dhash"))), "_b", int(perceptual * 64)).join(a, "pos_a").join(b, "pos_b")
    bits = bits.where("not coalesce(sha256_a = sha256_b, false) and (phash_a is null) = (phash_b is null)")
    out = out.unionByName(pairs(bits, "perceptual_image", F.round(F.col("distance") / 64, 4)))
    return out.withColumn("severity", F.when(F.col("kind").isin(BLOCKING), "block").otherwise("review"))


def audit(records: DataFrame, near: float = 0.82, perceptual: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """All conflicts, and for each id what follows: blocked, or else to be reviewed. Conflicts are sought once and kept on disk."""
    found = conflicts(records, near, perceptual).persist(StorageLevel.DISK_ONLY)
    worst = concerned(found, records.select("id", "pos")).groupBy("id").agg(F.min("severity").alias("s"))
    return found, worst.select("id", F.when(F.col("s") == "block", "blocked").otherwise("review").alias("status"))
