"""Keeping first rows, and telling equal names apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoints


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each key by time, then tie. Aggregated before the shuffle, so hot keys cost little."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def first_of_either(df: DataFrame, pos: str, a: str, b: str) -> DataFrame:
    """Rows kept when neither of two keys was kept before, in order of pos (unique). Null keys are a key like any other.

    In rounds: of the rows left, those that come first for both of their keys are kept, whatever shares a key with them
    is dropped. Each round is a checkpoint; no group is ever brought to one task. This is the sequential result, and
    few rounds are needed unless keys chain in the very order of pos.
    """
    checkpoints(df.sparkSession)
    left = df.select(F.col(pos).alias("p"), F.coalesce(F.col(a).cast("string"), F.lit("\0")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias("b")).checkpoint()
    kept = None
    while not left.isEmpty():
        first_a, first_b = left.groupBy("a").agg(F.min("p").alias("pa")), left.groupBy("b").agg(F.min("p").alias("pb"))
        now = left.join(first_a, "a").join(first_b, "b").where("p = pa and p = pb").select("p", "a", "b").checkpoint()
        kept = now.select("p") if kept is None else kept.unionAll(now.select("p"))
        left = left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("p", "a", "b").checkpoint()
    return df.limit(0) if kept is None else df.join(kept.withColumnRenamed("p", pos), pos, "left_semi")


def distinct_urls(df: DataFrame, url: str, canonical: Column, source: str, pos: str) -> DataFrame:
    """One row a canonical URL: its first spelling and all sources."""
    return df.withColumn("canonical_url", canonical).where("canonical_url <> ''").groupBy("canonical_url").agg(F.min_by(url, F.struct(pos, url)).alias("first_url"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n_rows"))


def numbered_names(df: DataFrame, name: str, pos: str, word: str = " Reaction ") -> DataFrame:
    """The second and later uses of a name get a number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(pos))
    return df.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(word), F.col("n").cast("string"))))


def suffixed(df: DataFrame, text: str, by: str, pos: str) -> DataFrame:
    """Later uses of a text, whatever its letter case, get the name of their record added."""
    n = F.row_number().over(Window.partitionBy(F.lower(text)).orderBy(pos))
    return df.withColumn("distinct_text", F.when(n == 1, F.col(text)).otherwise(F.concat(F.regexp_replace(text, "[.!?]+$", ""), F.lit(" ("), F.col(by), F.lit(")."))))


def concerned(conflicts: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, severity): whom each conflict concerns, the target against a reference; of two targets the later."""
    p = positions.select(F.col("id").alias("left_id"), F.col("pos").alias("lp"))
    q = positions.select(F.col("id").alias("right_id"), F.col("pos").alias("rp"))
    both = conflicts.join(p, "left_id").join(q, "right_id")
    who = F.when(F.col("left_scope") != F.col("right_scope"), F.when(F.col("left_scope") == "target", F.col("left_id")).otherwise(F.col("right_id"))).otherwise(F.when(F.col("lp") > F.col("rp"), F.col("left_id")).otherwise(F.col("right_id")))
    return both.select(who.alias("id"), "severity")


def blocked(conflicts: DataFrame, positions: DataFrame) -> DataFrame:
    """Ids that conflicts block."""
    return concerned(conflicts.withColumn("severity", F.lit("block")), positions).select("id").distinct()
