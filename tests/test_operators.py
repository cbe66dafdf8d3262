"""Operators on small tables and against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirthlake.operators import audit as A
from mirthlake.operators import catalogue as C
from mirthlake.operators import dedup as D
from mirthlake.operators import graph, quality, similarity
from mirthlake.operators import metrics as M
from mirthlake.operators import postings as X
from mirthlake.operators import ranking as K
from mirthlake.operators import retrieval as R


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(1, "x", "a", 1, 0.9), (1, "x", "b", 2, 0.8), (1, "y", "b", 1, 0.7), (1, "y", "c", 2, 0.6)], "query_id int, list string, id string, rank int, score double")
    assert [r["id"] for r in R.fuse(lists).orderBy("rank").collect()] == ["b", "a", "c"]


def test_reserve(spark):
    broad = spark.createDataFrame([(1, f"b{i:02}", i) for i in range(1, 31)], "query_id int, id string, rank int")
    core = spark.createDataFrame([(1, f"c{i:02}" if i != 2 else "b05", i) for i in range(1, 13)], "query_id int, id string, rank int")
    got = [r["id"] for r in R.with_reserve(broad, core).orderBy("rank").collect()]
    assert got == [f"b{i:02}" for i in range(1, 21)] + [f"c{i:02}" for i in range(1, 11) if i != 2] + ["b21"]


def test_bm25_without_overlap(spark):
    q = spark.createDataFrame([(1, "zzz"), (2, None), (3, "cat cat"), (4, "the and")], "query_id int, text string")
    d = spark.createDataFrame([("a", "a cat sat"), ("b", "cat cat"), ("c", None), ("d", "")], "id string, text string")
    assert [(r["query_id"], r["id"]) for r in R.bm25(q, d).orderBy("rank").collect()] == [(3, "b"), (3, "a")]


def test_bm25_pieces(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i:02d}", " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(60)]
    asked = [(i, " ".join(rng.choice(words, 4))) for i in range(30)] + [(0, "w1 w2"), (40, "nowhere")]
    own = {}
    for i, text in asked:
        own.setdefault(i, set()).update(text.split())
    split = {i: text.split() for i, text in docs}
    mean, df = sum(map(len, split.values())) / len(docs), {w: sum(w in x for x in split.values()) for w in words}
    want = set()
    for i, ws in own.items():
        score = {j: sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in ws if w in x) for j, x in split.items()}
        score = {j: math.floor(s * 1e6 + 0.5) / 1e6 for j, s in score.items()}
        best = sorted((j for j in score if score[j] > 0), key=lambda j: (-score[j], j))[:5]
        want |= {(i, j, score[j], r) for r, j in enumerate(best, 1)}
    q, d = spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(docs, "id string, text string")
    for got in (R.bm25(q, d, 5), R.bm25(q, d, 5, block=4, chunk=1000, piece=7), R.bm25(q, d, 5, block=4, chunk=20, piece=7)):
        assert {tuple(r) for r in got.collect()} == want
    # a task that has all documents ranks them itself: nothing is ranked again
    assert "Window" not in R.bm25(q, d, 5, block=4, chunk=1000)._jdf.queryExecution().optimizedPlan().toString()


def test_postings_look_few_documents_up(monkeypatch):
    rng = np.random.default_rng(3)
    n_docs, n_words, k, looked = 70_000, 700, 10, []
    chance = np.r_[np.full(50, 8), np.full(350, 3), np.full(300, 0.01)]
    lens = rng.integers(5, 40, n_docs)
    doc, word = np.repeat(np.arange(n_docs), lens), rng.choice(n_words, lens.sum(), p=chance / chance.sum())
    long = lens[doc] + (doc == 7) * (np.arange(len(doc)) % 2)  # a document that came with two texts
    kinds, tf = np.unique(np.stack([word, doc, long]), axis=1, return_counts=True)
    word, doc, long = kinds
    parts = []
    for low in (0, 40_000):
        mine = (doc >= low) & (doc < low + 40_000)
        first = np.flatnonzero(np.r_[True, np.diff(word[mine]) != 0])
        codes, code = np.unique(tf[mine] << 32 | long[mine], return_inverse=True)
        words = word[mine][first]
        parts.append((np.where(words == 60, -1, words), np.diff(np.r_[first, mine.sum()]), (doc[mine] - low).astype(np.uint16), code, codes >> 32, codes & 0xFFFFFFFF, min(40_000, n_docs - low)))
    df, mean, number = np.bincount(word, minlength=n_words), lens.mean(), rng.permutation(n_docs)
    idf = np.where(np.arange(n_words) == 60, 0, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)))
    texts = [rng.choice(np.delete(np.arange(n_words), 60), n, replace=False).tolist() for n in [20] * 25 + [1, 2, 0, 300]] + [[690], [695, 696]]
    found = X.Postings(parts, n_words, mean)
    places = X.places
    monkeypatch.setattr(X, "places", lambda mask: (looked.append(x := places(mask)), x)[1])
    got = list(found.search(texts, idf, number, k))
    few = sum(map(len, looked))
    for ws, (docs, score) in zip(texts, got):
        mine = np.isin(word, ws)
        s = np.bincount(doc[mine], idf[word[mine]] * tf[mine] * 2.2 / (tf[mine] + 1.2 * (0.25 + 0.75 * long[mine] / mean)), n_docs)
        s = np.floor(s * 1e6 + 0.5) / 1e6
        want = [i for i in np.lexsort((number, -s))[:k] if s[i] > 0]
        assert docs.tolist() == want and np.allclose(score, s[want], atol=1e-9)
    # few of the documents that have a word asked for are looked up
    assert few < 0.1 * len(texts) * n_docs


def test_fuse_shuffles_once(spark):
    lists = spark.createDataFrame([(1, "m", "a", 1, 2.0), (1, "e", "a", 2, 1.0), (1, "e", "b", 1, 3.0)], "query_id int, list string, id string, rank int, score double")
    got = R.fuse(lists, 2)
    assert [tuple(r)[:2] for r in got.orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_audit_seeks_conflicts_once(spark):
    kinds = "pos bigint, id string, scope string, name string, aliases array<string>, provider string, source_id string, image_url string, message string, relational_pattern string, sha256 string, phash string, dhash string"
    rows = [(1, "r1", "reference", "One Cat", None, "p", "1", "u1", None, None, None, None, None), (2, "t1", "target", "one cat", None, "p", "2", "u2", None, None, None, "00000000000000ff", None), (3, "t2", "target", "Other", None, "p", "3", "u3", None, None, None, "00000000000000fe", None), (4, "t3", "target", "Third", None, "p", "4", "u4", None, None, None, None, None), (5, "t4", "target", "one cat", None, "p", "5", "u5", None, None, None, "00000000000000fc", None)]
    found, status = A.audit(spark.createDataFrame(rows, kinds))
    assert {tuple(r) for r in status.collect()} == {("t1", "blocked"), ("t4", "blocked"), ("t2", "review")}
    assert found.where("kind = 'perceptual_image'").count() == 3
    # what follows from the conflicts is read from the ones found, not sought again
    plan = status._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and "Generate" not in plan.split("InMemoryRelation")[0]


def test_nearest_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 5)], "id int, v array<double>")
    got = R.nearest(df.withColumnRenamed("id", "query_id").where("query_id < 10"), df, 4, block=3, chunk=7)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    want = {(i, j) for i in range(10) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:4]}
    assert {(r["query_id"], r["id"]) for r in got.collect()} == want


def test_close_calls(spark):
    rows = [(1, "first", 0.9, 10, 1), (1, "close-low", 0.78, 10, 3), (1, "far", 0.8, 10, 2), (1, "close-high", 0.779, 99, 4)]
    df = spark.createDataFrame(rows, "q int, id string, s double, prior int, r int")
    got = {r["id"]: (r["head_no"], r["rank"]) for r in K.close_calls(df, "q", "id", "s", "prior", "r", 4).collect()}
    assert got == {"first": (1, 1), "close-high": (2, 2), "far": (2, 3), "close-low": (2, 4)}


def test_score_repair(spark):
    df = spark.createDataFrame([(1, 1, 88), (1, 2, 90), (1, 3, 99), (2, 1, None), (2, 2, 0), (2, 3, 5)], "q int, i int, s int")
    assert [r["repaired"] for r in K.descending_scores(df, "q", "i", "s").orderBy("q", "i").collect()] == [88, 87, 86, 60, 0, 0]


def test_assignment():
    scores = {"self": [("shared", 0.9), ("mine", 0.88)], "other": [("shared", 0.9), ("theirs", 0.88)], "situation": [("shared", 0.9), ("event", 0.3)]}
    assert [(lens, c) for lens, c, _ in K.assign(scores)] == [("self", "mine"), ("other", "theirs"), ("situation", "shared")]
    rng = random.Random(2)
    for _ in range(20):
        s = {lens: sorted(((c, rng.random()) for c in "abcde"), key=lambda x: -x[1]) for lens in ("self", "other", "situation")}
        assert sum(x for *_, x in K.assign(s)) >= K.all_assignments(s) - 0.06


def test_perspectives_fill(spark):
    df = spark.createDataFrame([(1, c, i, 0.5 - i / 100, 0.4, 0.3) for i, c in enumerate("abcd")], "query_id int, id string, retrieval_rank int, self double, other double, situation double")
    got = K.perspectives(df, ["self"], 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]


def test_first_of_either(spark):
    rng = random.Random(3)
    rows = [(i, f"a{rng.randrange(30)}", f"b{rng.randrange(30)}") for i in range(120)] + [(200, None, "b1"), (201, None, "z")]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(i)
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r["i"] for r in D.first_of_either(df, "i", "a", "b").collect()) == want
    assert D.first_of_either(df.limit(0), "i", "a", "b").count() == 0


def test_groups(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "u string, v string")
    got = {r["node"]: r["root"] for r in graph.groups(edges, "u", "v").collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["n20"] == "n00"


def test_latest_and_names(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, 1, None)], "k int, ts int, v string")
    assert sorted((r["k"], r["v"]) for r in D.latest(df, ["k"], "ts", "v").collect()) == [(1, "c"), (2, None)]
    n = spark.createDataFrame([("X", 1), ("X", 2), ("Y", 3)], "name string, pos int")
    assert [r["unique_name"] for r in D.numbered_names(n, "name", "pos").orderBy("pos").collect()] == ["X", "X Reaction 2", "Y"]


@pytest.mark.parametrize("t", [0.5, 0.82])
def test_set_join(spark, t):
    rng = random.Random(4)
    sets = [sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(8))}) for _ in range(60)]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= t}
    df = spark.createDataFrame(list(enumerate(sets)), "pos int, tokens array<string>")
    assert {(r["pos_a"], r["pos_b"]) for r in similarity.set_join(df, "tokens", t).collect()} == want


def test_bit_join(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(8)]
    vals = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(5)]
    vals = [v & (2**64 - 1) for v in vals]
    want = {(a, b) for a, b in itertools.combinations(range(len(vals)), 2) if bin(vals[a] ^ vals[b]).count("1") <= 5}
    df = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(vals)], "pos int, bits bigint")
    assert {(r["pos_a"], r["pos_b"]) for r in similarity.bit_join(df, "bits").collect()} == want


def test_audit(spark):
    spec = "pos bigint, id string, scope string, name string, aliases array<string>, provider string, source_id string, image_url string, message string, relational_pattern string, sha256 string, phash string, dhash string"
    rows = [
        (1, "r1", "reference", "Happy Cat", None, "P", "1", "https://x.test/a.png?w=1", "a cat is happy about the fresh fish", "joy over food", "h1", "ffff00000000ffff", None),
        (2, "r2", "reference", "Sad Dog", ["Happy cat"], "P", "2", None, None, None, "h2", None, None),
        (3, "t1", "target", "happy  CAT", None, "p", "1", "https://www.x.test/a.png?w=2", "a cat is happy about the fresh fish", "joy over food", "h1", None, None),
        (4, "t2", "target", "Other", None, "p", "9", "https://x.test/b.png", "a cat is happy about the fresh fish now", "joy over food", "h3", "ffff00000000fffe", None),
        (5, "t3", "target", None, None, None, None, None, None, None, None, None, None),
    ]
    found, status = A.audit(spark.createDataFrame(rows, spec))
    got = {(r["kind"], *sorted((r["left_id"], r["right_id"]))) for r in found.collect()}
    assert ("provider_source_id", "r1", "t1") in got and ("canonical_image_url", "r1", "t1") in got and ("normalized_name", "r1", "t1") in got and ("normalized_name", "r2", "t1") in got
    assert ("exact_semantic_metadata", "r1", "t1") in got and ("near_semantic_metadata", "r1", "t2") in got and ("exact_image_content", "r1", "t1") in got and ("perceptual_image", "r1", "t2") in got
    assert not any({a, b} == {"r1", "r2"} for _, a, b in got) and not any("t3" in x for x in got)
    assert {r["id"]: r["status"] for r in status.collect()} == {"t1": "blocked", "t2": "review"}


def test_rules(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, "x"), ("c", 3, None)], "id string, n int, k string")
    got = sorted((r["row_id"], r["rule"]) for r in quality.violations(df, "id", [quality.Rule("n_is_small", F.col("n") < 3), quality.Rule("k_is_unique", quality.unique("k"))]).collect())
    assert got == [("a", "k_is_unique"), ("b", "k_is_unique"), ("b", "n_is_small"), ("c", "n_is_small")]
    with pytest.raises(ValueError, match="n_is_small"):
        quality.assert_clean(quality.violations(df, "id", [quality.Rule("n_is_small", F.col("n") < 3)]), "rows")
    assert [r["rule"] for r in quality.counts(df, {"three_rows": (F.lit(True), 3), "one_x": (F.col("k") == "x", 1)}).collect()] == ["one_x"]


def test_catalogue(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 2, "y")], "id string, n int, s string")
    o = spark.createDataFrame([("a", 9)], "id string, n int")
    assert {r["id"]: r["n"] for r in C.overridden(a, o, "id").collect()} == {"a": 9, "b": 2}
    with pytest.raises(LookupError):
        C.looked_up(a, o.withColumnRenamed("n", "m"), "id", "m")
    assert [tuple(r) for r in C.changed(a, a.withColumn("s", F.lit(None).cast("string")), "id", ["n", "s"]).collect()] == [("b", "s")]
    assert C.same_rows(a, a.orderBy(F.desc("id"))) and not C.same_rows(a, a.limit(1))
    assert [r["id"] for r in C.page(a, 7, 1, "id").collect()] == ["b"]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 4), (1, "c", 2.0, 0), (2, "d", 1.0, 0)], "q int, id string, s double, r int")
    n = {r["q"]: r["ndcg"] for r in M.ndcg(df, "q", "id", "s", "r").collect()}
    assert n[1] == pytest.approx((1 + 15 / np.log2(3)) / (15 + 1 / np.log2(3)), abs=1e-6) and n[2] == 0
    p = {r["q"]: (r["accuracy"], r["n_pairs"]) for r in M.pairwise_accuracy(df, "q", "s", F.col("r") >= 3).collect()}
    assert p == {1: (0.25, 2), 2: (None, 0)}


def test_answers(spark):
    from mirthlake.operators import answers

    good = '{"decision":"meme","confidence":"high","none_reason":"","candidates":[{"id":"a","score":80,"reason":"fits"},{"id":"b","score":80,"reason":"too"}]}'
    rows = {"fenced": "```json\n" + good + "\n```", "bare": good, "broken": good[:-3], "null": None, "strange": good.replace('"b"', '"z"'), "high": good.replace('"b","score":80', '"b","score":101'), "twice": good.replace('"b"', '"a"'), "unsure": good.replace("high", "sure"), "empty": '{"decision":"none","confidence":"low","none_reason":"nothing","candidates":[]}', "odd": '{"decision":"none","confidence":"high","none_reason":"nothing","candidates":[]}', "many": good.replace('{"id":"a"', '{"id":"a","score":1,"reason":"x"},' * 5 + '{"id":"a"')}
    df = spark.createDataFrame(list(rows.items()), "k string, t string")
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r["k"]: r["fault"] for r in answers.judged(df, "k", "t", known).collect()}
    assert got == {"fenced": None, "bare": None, "broken": "not_json", "null": "not_json", "strange": "unknown_candidate", "high": "score", "twice": "duplicate", "unsure": "confidence", "empty": None, "odd": "contradiction", "many": "too_many"}
    put = {r["k"]: r for r in answers.normalised(df, "k", "t").collect()}
    assert set(put) == set(rows) - {"broken", "null"}
    assert [(c["id"], c["score"]) for c in put["bare"]["candidates"]] == [("a", 80), ("b", 79)] and put["odd"]["confidence"] == "low" and put["unsure"]["confidence"] == "low" and put["empty"]["decision"] == "none"
    assert answers.judged(df.limit(0), "k", "t", known).count() == 0 and answers.normalised(df.limit(0), "k", "t").count() == 0


def test_hash_of_ids(spark):
    import hashlib

    from mirthlake.operators import metrics

    ids = [f"x{i:04}" for i in range(3000)]
    got = metrics.id_hash(spark.createDataFrame([(i,) for i in reversed(ids)] + [(None,)], "id string").repartition(7), "id").collect()
    assert [tuple(r) for r in got] == [(hashlib.sha256("\n".join(ids).encode()).hexdigest(), 3000)]
    assert [tuple(r) for r in metrics.id_hash(spark.createDataFrame([], "id string"), "id").collect()] == [(hashlib.sha256(b"").hexdigest(), 0)]


def test_alias_within_words(spark):
    from mirthlake.operators import similarity

    items = spark.createDataFrame([("i", ["big cat", ""]), ("j", ["owl"]), ("k", ["none such"])], "item_id string, aliases array<string>")
    records = spark.createDataFrame([("r2", "r2", "the growling big catalogue"), ("r1", "r1", "big ca t"), ("r3", "r3", "a big cat"), ("r4", "r4", None), ("r5", "r5", "ow")], "id string, pos string, text string")
    assert {tuple(r) for r in similarity.covered_by_alias(items, records).collect()} == {("i", "r2"), ("j", "r2"), ("k", None)}
    assert {tuple(r) for r in similarity.covered_by_alias(items.withColumn("aliases", F.array(F.lit(""))), records).collect()} == {("i", None), ("j", None), ("k", None)}


def test_bit_join_all_bands(spark):
    import random

    from mirthlake.operators import similarity

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), n)) for b in base for n in (1, 5, 6)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "pos int, bits bigint")
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 5}
    for together in (1, 2, 3):
        assert {tuple(r) for r in similarity.bit_join(df, "bits", 5, together=together).collect()} == want


def test_bit_values_each_pair_once(spark):
    from mirthlake.operators import similarity

    df = spark.createDataFrame([(i, v) for i, v in enumerate([0] * 300 + [1, 3, -1, 1 << 40])], "pos int, bits bigint")
    got = sorted(tuple(r) for r in similarity.bit_values(df, "bits").collect())
    assert got == [(0, 1, 1), (0, 3, 2), (0, 1 << 40, 1), (1, 3, 1), (1, 1 << 40, 2), (3, 1 << 40, 3)]


def test_image_groups_of_copies(spark, tmp_path):
    from mirthlake.plans import rules

    rows = [(f"i{i}", [1.0] * 64, 0) for i in range(5)] + [("j0", [-1.0] * 6 + [1.0] * 58, 0), ("k1", [-1.0] * 64, 0), ("k0", [-1.0] * 60 + [1.0] * 4, 0), ("k1", [-1.0] * 64, 0), ("l", [1.0], 0), ("m", None, 0), ("n", [-1.0] * 32 + [1.0] * 32, 0)]
    spark.createDataFrame(rows, "id string, embedding array<float>, ingested_at long").write.parquet(f"{tmp_path}/stage_3000_local_signals.parquet")
    assert {tuple(r) for r in rules.image_groups(spark, str(tmp_path)).collect()} == {(f"i{i}", "i0") for i in range(5)} | {("k0", "k0"), ("k1", "k0")}
