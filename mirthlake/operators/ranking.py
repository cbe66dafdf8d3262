"""Ranking: folds over ranked lists, perspective assignment and selection shaping."""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P


def descending_scores(df: DataFrame, by: str, order: str, score: str, out: str = "repaired") -> DataFrame:
    """Each score at least one below the one before, within 0..100; a missing one counts as 60.

    The running minimum of score + place gives what the fold gives, as a window over each list.
    """
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    w = Window.partitionBy(by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    lifted = df.withColumn("_i", i).withColumn("_s", F.least(F.lit(100), F.coalesce(F.col(score), F.lit(60))) + F.col("_i"))
    return lifted.withColumn(out, F.greatest(F.lit(0), F.min("_s").over(w) - F.col("_i")).cast("int")).drop("_i", "_s")


def close_calls(df: DataFrame, by: str, id_: str, score: str, prior: str, retrieval_rank: str, limit: int, margin: float = P.CLOSE_MARGIN) -> DataFrame:
    """The limit best of each group; those whose score is within margin of their group's head are ordered by prior.

    A new head begins where the score falls more than margin below the last head, so heads are found by a fold over
    the (at most limit long) ordered array; adds head_no and rank.
    """
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.col(retrieval_rank), F.col(id_)))).where(F.col("_r") <= limit)
    rows = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(score).cast("double").alias("s")))).alias("a"))
    zero = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fresh = acc["head"].isNull() | (acc["head"] - x["s"] > margin)
        no = F.when(fresh, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(F.when(fresh, x["s"]).otherwise(acc["head"]).alias("head"), no.alias("no"), F.concat(acc["out"], F.array(no)).alias("out"))

    heads = rows.select(by, F.posexplode(F.aggregate("a", zero, step)["out"]).alias("_p", "head_no")).withColumn("_r", F.col("_p") + 1).drop("_p")
    out = top.join(heads, [by, "_r"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("head_no", F.desc(prior), "_r"))).drop("_r")


def assign(scores: dict[str, list[tuple[str, float]]], margin: float = P.CLOSE_MARGIN) -> list[tuple[str, str, float]]:
    """(lens, id, score): a different candidate for each lens.

    Assignments are tried in the order of the lenses' lists. One replaces the best so far if its total is more than
    margin greater, or within margin with more for the lenses other than situation; the order is part of the result.
    """
    lenses = list(scores)
    best: tuple | None = None

    def go(at: int, used: tuple, picked: tuple, total: float, own: float) -> None:
        nonlocal best
        if at == len(lenses):
            if best is None or total > best[1] + margin or abs(total - best[1]) <= margin and own > best[2]:
                best = (picked, total, own)
            return
        for c, s in scores[lenses[at]]:
            if c not in used:
                go(at + 1, (*used, c), (*picked, (lenses[at], c, s)), total + s, own + (0.0 if lenses[at] == "situation" else s))

    go(0, (), (), 0.0, 0.0)
    return list(best[0]) if best else []


def perspectives(df: DataFrame, lenses: list[str], limit: int = 3) -> DataFrame:
    """(query_id, id, lens, score, rank) from candidates (query_id, id, retrieval_rank, one score column a lens).

    One candidate a lens by assign(), filled up to limit from all (lens, candidate) rows by score. A group is one
    query's shortlist, so it is small.
    """
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {lens: pdf.sort_values([lens, "retrieval_rank", "id"], ascending=[False, True, True]) for lens in lenses}
        ordered = {lens: list(zip(x["id"].tolist(), x[lens].astype(float).tolist())) for lens, x in by.items()}
        picked = assign(ordered)
        used = {c for _, c, _ in picked}
        place = dict(zip(pdf["id"], pdf["retrieval_rank"]))
        for s, _, c, lens in sorted((-s, place[c], c, lens) for lens in lenses for c, s in ordered[lens]):
            if len(picked) >= limit:
                break
            if c not in used:
                used.add(c)
                picked.append((lens, c, -s))
        picked = sorted(picked[:limit], key=lambda x: (-x[2], x[0]))
        return pd.DataFrame([(pdf["query_id"].iloc[0], c, lens, s, i + 1) for i, (lens, c, s) in enumerate(picked)], columns=["query_id", "id", "lens", "score", "rank"])

    return df.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, id {kinds['id']}, lens string, score double, rank int")


def ordinal_rank(df: DataFrame, by: str, id_: str, score: str, retrieval_rank: str, limit: int) -> DataFrame:
    """By score, retrieval rank and id; groups in which all of several scores are equal are left out as failed."""
    w = Window.partitionBy(by)
    ok = df.withColumn("_flat", (F.min(score).over(w) == F.max(score).over(w)) & (F.count("*").over(w) > 1)).where("not _flat").drop("_flat")
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.col(retrieval_rank), F.col(id_)))).where(F.col("rank") <= limit)


def shaped(df: DataFrame, by: str, score: str, threshold: float = 0.0) -> DataFrame:
    """Rows of rank 1, and those that reach threshold, with score 0..100, label and the list's confidence."""
    kept = df.where((F.col("rank") == 1) | (F.col(score) >= threshold))
    best = F.max(score).over(Window.partitionBy(by))
    confidence = F.when(best >= 0.9, "high").when(best >= 0.75, "medium").otherwise("low")
    return kept.withColumn("percent", N.half_up(F.col(score) * 100)).withColumn("label", N.fit_label(F.col(score))).withColumn("confidence", confidence)


def balanced_scores(pairs: DataFrame) -> DataFrame:
    """(query_id, id, score) from both orders of a comparison (query_id, a, b, p): mean over opponents of p and 1-p, as 0..100."""
    forward = pairs.select("query_id", F.col("a").alias("id"), F.col("b").alias("other"), F.col("p").alias("p"))
    backward = pairs.select("query_id", F.col("b").alias("id"), F.col("a").alias("other"), (1 - F.col("p")).alias("p"))
    per = forward.unionByName(backward).groupBy("query_id", "id", "other").agg(F.avg("p").alias("p"))
    return per.groupBy("query_id", "id").agg((F.avg("p") * 100).alias("score"))


def diverse(df: DataFrame, id_: str, tags: str, score: str, count: int = 30, pool: int = 8) -> list[str]:
    """count ids, each time the one whose tags are least seen so far, ties by score and id; from the pool*count best.

    The only step that is sequential by nature: the pool is at most pool*count rows, taken by the engine's top-k.
    """
    rows = df.orderBy(F.desc(score), F.col(id_)).limit(count * pool).select(id_, tags).collect()
    left, seen, out = [(r[0], sorted({t.strip().lower() for t in r[1] or [] if t and t.strip()})) for r in rows], {}, []
    while left and len(out) < count:
        best = max(range(len(left)), key=lambda i: (sum(1 / (1 + seen.get(t, 0)) for t in left[i][1]), -i))
        i, own = left.pop(best)
        out.append(i)
        for t in own:
            seen[t] = seen.get(t, 0) + 1
    return out


def all_assignments(scores: dict[str, list[tuple[str, float]]]) -> float:
    """Greatest total over injective assignments, by trying all; for tests."""
    lenses = list(scores)
    ids = sorted({c for v in scores.values() for c, _ in v})
    table = {lens: dict(v) for lens, v in scores.items()}
    return max(sum(table[lens][c] for lens, c in zip(lenses, p)) for p in permutations(ids, len(lenses)))
