"""Problem 2 against brute force, the sketch's accuracy, and edge cases."""

import random

import numpy as np
import pyarrow as pa

from mirthlake.llm import near_duplicates as D
from mirthlake.llm.graph import components
from mirthlake.llm.text import word_hashes, words

SPEC = "id string, a string, b string, cid int, ws string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, 1, "x", 2) for i, a, b in rows], SPEC)


def pairs(spark, rows, **kw):
    return {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(frame(spark, rows), "id", ["a", "b"], **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(40)]
        for c in range(rng.randrange(1, 4)):
            ws = [f"n{rng.randrange(99999)}" if rng.random() < rng.choice([0, 0.1, 0.2]) else w for w in base]
            rows.append((f"r{i}-{c}", " ".join(ws[:20]), " ".join(ws[20:])))
    sets = {i: words(f"{a} {b}") for i, a, b in rows}
    like = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in sets for y in sets if x < y}
    want = {p for p, s in like.items() if s >= 0.6}
    got = pairs(spark, rows)
    assert got <= want and len(want) > 20
    assert {p for p in want if like[p] >= 0.65} <= got and len(got) >= 0.98 * len(want)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [("a", "one two", None), ("b", None, "two one"), ("b", None, "two one"), ("c", None, None), ("d", "", " "), (None, "one two", None), ("e", long, None), ("f", long, "more"), ("g", "one two three four", None)]
    assert pairs(spark, rows) == {("a", "b"), ("e", "f")}
    assert pairs(spark, []) == set()
    groups = {r["id"]: (r["group_id"], r["n_copies"], r["n_links"]) for r in D.near_duplicate_groups(frame(spark, rows), "id", ["a", "b"]).collect()}
    assert groups == {"a": ("a", 2, 0), "b": ("a", 2, 0), "c": ("c", 1, 0), "d": ("d", 1, 0), "e": ("e", 1, 1), "f": ("e", 1, 1), "g": ("g", 1, 0)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    make = D.Sketcher()
    n, err = [], []
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**62, 60))
        b = np.unique(np.concatenate([a[:45], rng.integers(0, 2**62, 15)]))
        x, y = make(a), make(b)
        assert (make(np.unique(np.concatenate([a, b]))) == np.maximum(x, y)).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        err.append(D.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))[0] - j)
        n.append((x == y).mean() - j)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.03 and abs(np.mean(n)) < 0.05
    assert (make(word_hashes("one", {})) == D.word_registers(int(word_hashes("one", {})[0]))).all()


def test_components(spark):
    rows = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (100, 102)] + [(500, i) for i in range(501, 530)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()}
    assert got[30] == 0 and got[102] == 100 and got[529] == 500 and len(got) == 31 + 3 + 30
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_groups_hold_the_pairs(spark, tmp_path):
    from mirthlake.llm import queries_near as Q

    spec = "id string, message string, relational_pattern string, example_context string, ingested_at timestamp"
    texts = [("a", "one two three four five six seven"), ("b", "one two three four five six eight nine"), ("c", "ten eleven twelve")]
    spark.createDataFrame([(i, x, None, None, None) for i, x in texts], spec).write.parquet(f"{tmp_path}/catalogue.parquet")
    assert [tuple(r) for r in Q.p2_found(spark, str(tmp_path)).collect()] == [("a", "b")]
    assert {(r["id"], r["group_id"], r["n_links"]) for r in Q.p2_groups(spark, str(tmp_path)).collect()} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 0)}


def test_word_sets_are_never_broadcast(spark, tmp_path):
    """Sizes known from compressed files say nothing of the word sets; with a threshold of 1 GB, all would go to the driver."""
    rows = [(f"r{i}", " ".join(f"w{i % 40 * 50 + j}" for j in range(30)), f"x{i}") for i in range(120)]
    frame(spark, rows).write.parquet(f"{tmp_path}/t.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1g")
    try:
        df = D.near_duplicate_pairs(spark.read.parquet(f"{tmp_path}/t.parquet"), "id", ["a", "b"])
        assert df.count() == 120 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


def test_rounds_find_the_same(spark):
    rng = random.Random(4)
    rows = [(f"r{i}-{c}", " ".join(f"w{i * 40 + j}" if rng.random() > 0.1 else f"n{rng.randrange(9999)}" for j in range(40)), None) for i in range(30) for c in range(3)]
    _, classes = D._sets(frame(spark, rows), "id", ["a", "b"])
    pairs = [{tuple(r) for r in D.similar_classes(classes, (3, 5), rounds=n).collect()} for n in (1, 5)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 60


def test_long_sets_and_long_runs_of_one_key():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(2**62), 2**62, n)) for n in (5, 300, 1, 120)]
    whole = np.array([np.max([D.word_registers(int(w)) for w in ws], axis=0) for ws in sets])
    assert (D.sketches(sets, most=64) == whole).all() and (D.sketches(sets, 12, 30) == whole[:, 12:30]).all()
    n = 70
    batch = pa.RecordBatch.from_arrays([pa.array([1] + [7] * n + [9, 9]), pa.array(range(n + 3)), pa.array([10] * (n + 3), pa.int32()), pa.array([0] * (n + 2) + [-1]), pa.array([0] * (n + 3))], names=["key", "cid", "n", "bits", "more"])
    got = {p for b in D.pairs_of_keys(iter([batch.slice(0, 30), batch.slice(30)]), 3, 5, most=16) for p in zip(*(b.column(c).to_pylist() for c in "ab"))}
    assert got == {(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)}
