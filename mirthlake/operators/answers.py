"""Answers of models: parsed from fenced JSON, judged by rules, and put into order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "decision string, confidence string, none_reason string, candidates array<struct<id: string, score: bigint, reason: string>>, _corrupt_record string"
#: What a selection with nothing in it says.
NOTHING = "Nothing known is a natural fit."


def unfenced(c: Column) -> Column:
    """Text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def parsed(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, given, decision, confidence, none_reason, candidates); given is false, the rest null, where the text is no JSON object."""
    j = F.from_json(unfenced(F.col(answer)), SHAPE, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    x = df.select(key, j.alias("j")).withColumn("given", F.col("j").isNotNull() & F.col("j._corrupt_record").isNull())
    return x.select(key, "given", *[F.when(F.col("given"), F.col(f"j.{c}")).alias(c) for c in ("decision", "confidence", "none_reason", "candidates")])


def judged(df: DataFrame, key: str, answer: str, known: DataFrame, most: int = 5) -> DataFrame:
    """(key, fault): the first rule that an answer breaks, null if it is good. known: id STRING of all candidates allowed.

    Candidates are looked up by a join, so the table of known ids may be of any size. Missing parts break the rule on
    them.
    """
    p = parsed(df, key, answer)
    ids = p.select(key, F.explode("candidates.id").alias("_candidate"))
    strange = ids.join(known.select(F.col("id").alias("_candidate")), "_candidate", "left_anti").select(key).distinct().withColumn("strange", F.lit(True))
    p = p.join(strange, key, "left")
    c, n = F.col("candidates"), F.size("candidates")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    none = F.col("decision") == "none"
    fault = (
        F.when(~F.col("given"), "not_json")
        .when(no(F.col("decision").isin("meme", "none")), "decision")
        .when(no(F.col("confidence").isin("high", "medium", "low")), "confidence")
        .when(no(n <= most), "too_many")
        .when(F.col("strange"), "unknown_candidate")
        .when(no(F.forall(c, lambda x: F.trim(x["reason"]) != "")), "reason")
        .when(no(F.forall(c, lambda x: x["score"].between(0, 100))), "score")
        .when(F.size(F.array_distinct(F.transform(c, lambda x: x["id"]))) < n, "duplicate")
        .when(~none & (n == 0), "no_candidates")
        .when(none & ((n > 0) | no(F.trim("none_reason") != "") | (F.col("confidence") != "low")), "contradiction")
    )
    return p.select(key, fault.alias("fault"))


def normalised(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, decision, confidence, none_reason, candidates): what an answer amounts to; texts that are no JSON are left out.

    Candidates come by falling score (60 where none is given, cut to 0..100, ties in the order given), each lower than
    the one before it by one at least, down to 0. An answer with candidates is a meme, one without is none.
    """
    p = parsed(df, key, answer).where("given")
    score = lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(100).cast("bigint"), F.coalesce(x["score"], F.lit(60).cast("bigint"))))
    placed = F.array_sort(F.transform(F.coalesce("candidates", F.array().cast("array<struct<id: string, score: bigint, reason: string>>")), lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x["id"].alias("id"), x["reason"].alias("reason"))))
    empty = F.array().cast("array<struct<id: string, score: bigint, reason: string>>")
    below = lambda acc, x: F.when(F.size(acc) == 0, -x["s"]).otherwise(F.greatest(F.lit(0).cast("bigint"), F.least(-x["s"], F.element_at(acc, -1)["score"] - 1)))
    falling = F.aggregate(placed, empty, lambda acc, x: F.concat(acc, F.array(F.struct(x["id"].alias("id"), below(acc, x).alias("score"), x["reason"].alias("reason")))))
    some = F.size("candidates") > 0
    p = p.withColumn("candidates", falling)
    return p.select(
        key,
        F.when(some, "meme").otherwise("none").alias("decision"),
        F.when(some & F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low").alias("confidence"),
        F.when(some, "").when(F.trim("none_reason") != "", F.col("none_reason")).otherwise(NOTHING).alias("none_reason"),
        "candidates",
    )
