"""Evaluation metrics as aggregates over long tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def rate(hit: Column, of: Column | None = None, guarded: bool = False) -> Column:
    """Share of rows (or of rows with of) with hit; null, or 0 if guarded, when there are none."""
    r = F.try_divide(F.count_if(hit if of is None else hit & of).cast("double"), F.count("*") if of is None else F.count_if(of))
    return F.coalesce(r, F.lit(0.0)) if guarded else r


def nearest_rank(c: str, f: float) -> Column:
    return F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {c})")


def ndcg(df: DataFrame, by: str, id_: str, score: str, rating: str, k: int = 5) -> DataFrame:
    """(by, ndcg): gain 2^rating - 1, discount log2(place + 1); 0 where the ideal is 0."""
    got = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.col(id_)))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(rating), F.col(id_)))
    r = df.withColumn("_g", got).withColumn("_b", best).withColumn("_v", F.pow(F.lit(2.0), rating) - 1)
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col("_v") / F.log2(F.col(place) + 1)).otherwise(0.0))
    return r.groupBy(by).agg(part("_g").alias("dcg"), part("_b").alias("ideal")).select(by, N.rounded(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))).alias("ndcg"))


def pairwise_accuracy(df: DataFrame, by: str, score: str, positive: Column) -> DataFrame:
    """(by, accuracy, n_pairs): positives above negatives, ties half; null where there are none.

    Counted from sorted distinct scores by cumulative sums, never from pairs.
    """
    per = df.groupBy(by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = per.withColumn("won", F.col("p") * (below + F.col("n") * 0.5)).groupBy(by).agg(F.sum("won").alias("won"), (F.sum("p") * F.sum("n")).alias("n_pairs"))
    return g.select(by, N.rounded(F.try_divide(F.col("won"), F.col("n_pairs").cast("double"))).alias("accuracy"), "n_pairs")


def graded_accuracy(df: DataFrame, by: str, id_: str, score: str, rating: str) -> DataFrame:
    """(by, accuracy, n_pairs): pairs with different ratings whose scores agree, ties half. by must be a short list."""
    a, b = df.select(by, F.col(id_).alias("ia"), F.col(score).alias("sa"), F.col(rating).alias("ra")), df.select(by, F.col(id_).alias("ib"), F.col(score).alias("sb"), F.col(rating).alias("rb"))
    p = a.join(b, by).where("ia < ib and ra <> rb")
    won = F.when(F.col("sa") == F.col("sb"), 0.5).when(F.signum(F.col("sa") - F.col("sb")) == F.signum((F.col("ra") - F.col("rb")).cast("double")), 1.0).otherwise(0.0)
    return p.groupBy(by).agg(N.rounded(F.avg(won)).alias("accuracy"), F.count("*").alias("n_pairs"))


def calibration(score: Column, label: Column, rating: Column) -> list[Column]:
    """Brier, ordinal error, precision of high scores and number of wrongly high ones."""
    return [
        N.rounded(F.avg(F.pow(score / 100 - label.cast("double"), F.lit(2)))).alias("brier"),
        N.rounded(F.avg(F.abs(score - 25 * rating))).alias("ordinal_mae"),
        N.rounded(F.avg(F.when(score >= 75, label.cast("double")))).alias("high_precision"),
        F.count_if((score >= 75) & (rating <= 1)).alias("n_wrongly_high"),
    ]


def recall_at(df: DataFrame, acceptable: DataFrame, ks: list[int]) -> DataFrame:
    """One row of recall@k for ranked rows (query_id, id, rank) and acceptable (query_id, id)."""
    first = acceptable.join(df, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return first.agg(F.count("*").alias("n_cases"), *[N.rounded(rate(F.coalesce(F.col("first_rank") <= k, F.lit(False)))).alias(f"recall_at_{k}") for k in ks])


def diagnosis() -> Column:
    """First gap that explains a case; needs flags in_data, retrieved, failed, humour, top_rank."""
    return F.when(~F.col("in_data"), "data_gap").when(F.col("failed"), "provider_gap").when(~F.col("humour"), "safety_gap").when(~F.col("retrieved"), "retrieval_gap").when(F.col("top_rank").isNull(), "ranking_gap").when(F.col("top_rank") > 1, "ordering_gap").otherwise("pass")


def id_hash(df: DataFrame, c: str) -> DataFrame:
    """(hash, n): SHA-256 of the sorted ids joined by line breaks, and their number; null ids are left out.

    The hash is a chain over all ids, so one task reads them one after another; they are sorted in parallel before
    (each range by itself) and held by no one.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                if x is not None:
                    h.update((b"\n" if n else b"") + x.encode())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n])], names=["hash", "n"])

    # one null row more, so that no ids have a hash too
    ids = df.select(F.col(c).cast("string").alias("id")).unionAll(df.sparkSession.range(1).select(F.lit(None).cast("string")))
    return ids.orderBy("id").coalesce(1).mapInArrow(chain, "hash string, n bigint")


def abstentions(df: DataFrame) -> DataFrame:
    """One row of safety rates over cases with flags wants_humour, factual, serious, humour_ok (the classifier's answer).

    Factual cases are declined unasked; of the rest serious ones are put to the classifier; what remains gets a meme.
    """
    cue = F.col("factual") | F.col("serious")
    called = cue & ~F.col("factual")
    humour = F.when(called, F.col("humour_ok")).otherwise(~cue)
    x = df.select("wants_humour", cue.alias("cue"), called.alias("called"), (cue & ~humour).alias("declined"))
    no, yes = ~F.col("wants_humour"), F.col("wants_humour")
    wrong = rate(F.col("declined"), yes, guarded=True)
    return x.agg(
        F.count("*").alias("n_cases"),
        N.rounded(rate(F.col("declined"), no, guarded=True)).alias("correct_abstention"),
        N.rounded(rate(~F.col("declined"), no, guarded=True)).alias("inappropriate_joking"),
        N.rounded(1 - wrong).alias("humour_recall"),
        N.rounded(wrong).alias("false_abstention"),
        N.rounded(rate(F.col("cue"))).alias("cue_rate"),
        N.rounded(rate(F.col("called"))).alias("call_rate"),
    )


def top_ratings(df: DataFrame, by: str, id_: str, score: str, rating: str, sendable: int = 3) -> DataFrame:
    """(by, top_is_best, top_rating, any_exact, any_sendable): what the first place by score (ties by id) is worth."""
    # the greatest score, of equal ones the least id
    g = df.groupBy(by).agg(F.min_by(rating, F.struct(-F.col(score), F.col(id_))).alias("top_rating"), F.max(rating).alias("most"), F.bool_or(F.col(rating) >= 4).alias("any_exact"), F.bool_or(F.col(rating) >= sendable).alias("any_sendable"))
    return g.select(by, (F.col("top_rating") == F.col("most")).alias("top_is_best"), "top_rating", "any_exact", "any_sendable")


def first_ranks(df: DataFrame, acceptable: DataFrame) -> DataFrame:
    """(query_id, first_rank, missed): the best rank of an acceptable id among ranked rows, null where all were missed, and the ids missed."""
    both = acceptable.join(df.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.col("id")))).alias("missed"))


def condition_counts(df: DataFrame, by: str) -> DataFrame:
    """Eleven counters a condition over arms with status, decision, intent_label, verdict, first_id and verdict_id.

    Arms that failed count as runs only; unreviewed ones (null verdict) as no review; a case without intent_label is
    neither humour nor without meme.
    """
    ok = F.col("status") == "ok"
    meme, none = ok & (F.col("decision") == "meme"), ok & (F.col("decision") == "none")
    bare = F.col("intent_label") == "no_meme"
    seen = ok & F.col("verdict").isNotNull()
    humour = seen & (F.col("intent_label") == "humour")
    send = humour & (F.col("verdict") == "send")
    counters = {"runs": F.lit(True), "ok": ok, "reviewed": seen, "meme_decisions": meme, "none_decisions": none, "humour_reviewed": humour, "top_one_sendable": send & (F.col("first_id") == F.col("verdict_id")), "top_three_sendable": send, "no_meme_cases": ok & bare, "correct_abstentions": none & bare, "inappropriate_joking": meme & bare}
    return df.groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def vector_fault(vector: str, size: int) -> Column:
    """Why a vector can't be searched with: missing, wrong_length, not_finite or zero; null for good ones."""
    v = F.col(vector)
    return F.when(v.isNull(), "missing").when(F.size(v) != size, "wrong_length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(~F.exists(v, lambda x: x != 0), "zero")
