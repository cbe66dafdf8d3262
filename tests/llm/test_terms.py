"""Problem 3 against plain counting, the trie, and edge cases."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from mirthlake.llm import queries_terms as Q
from mirthlake.llm import term_counts as C


def test_against_counting(spark):
    rng = random.Random(1)
    rows = [[f"Term {'abc'[rng.randrange(3)] * rng.randrange(4)}{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(6))] for _ in range(3000)]
    rows[:3] = [None, [None, "", "  ", "-"], ["É", "É", "e-_ f"]]
    df = spark.createDataFrame([(r, 1, "x") for r in rows], "terms array<string>, prefix int, word string").repartition(5)
    uses, recs = Counter(), Counter()
    for r in rows:
        ts = [t for t in map(C.term_of, r or []) if t]
        uses.update(ts)
        recs.update(set(ts))
    want = {(t, n, recs[t], "rare" if recs[t] < 3 else "common" if recs[t] > 0.05 * len(rows) else "useful") for t, n in uses.items()}
    for full in (200_000, 50):
        assert {tuple(r) for r in C.term_frequencies(df, "terms", full=full).collect()} == want


def test_edges(spark):
    df = spark.createDataFrame([], "terms array<string>")
    assert C.term_frequencies(df, "terms").count() == 0
    long = "x" * 50_000
    got = {r["term"]: (r["n_uses"], r["n_records"]) for r in C.term_frequencies(spark.createDataFrame([(["a", "A ", "a"],), ([long],), ([long.upper()],)], "terms array<string>"), "terms").collect()}
    assert got == {"a": (3, 1), long: (2, 2)}


def test_term_of():
    assert C.term_of("  Ab - _ cd  ") == "ab-cd" and C.term_of("--") == "-" and C.term_of(" ") is None and C.term_of("é") == "é"


def test_trie():
    trie = C.BurstTrie(burst=2)
    for t in ["", "a", "ab", "abc", "abcd", "b", "abc", ""]:
        trie.add(t, 1, 1)
    assert {p + e: x[0] for p, ends in trie.leaves() for e, x in ends.items()} == {"": 2, "a": 1, "ab": 1, "abc": 2, "abcd": 1, "b": 1} and trie.size == 6


def test_sql(spark, data):
    con = duckdb.connect()
    for n in ("stage_300_seed", "stage_3000_reaction_gif_replacements"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{data}/{n}.parquet'")
    assert {tuple(r) for r in Q.p3_found(spark, data).select("term", "n_uses", "n_records", "mark").collect()} == set(con.execute(Q.P3).fetchall())


def test_long_common_prefix_is_split(spark):
    terms = [f"reaction-{i}" for i in range(6000)] + ["reaction", "reactio"]
    df = spark.createDataFrame([(terms[i::20],) for i in range(20)] + [(["Reaction-7"],)], "terms array<string>").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.term_frequencies(df, "terms").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r["term"], r["n_uses"]) for r in got} == {(t, 1 + (t == "reaction-7")) for t in terms} and len(got) == len(terms)
    assert max(Counter(r["task"] for r in got).values()) < 0.6 * len(terms)
