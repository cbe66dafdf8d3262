"""Readers, writers, plug-ins and streams."""

import json

import pytest
from pyspark.sql import functions as F

from mirthlake.sources import plugins
from mirthlake.sources import readers as S
from mirthlake.streaming import events as E


def test_formats(spark, tmp_path):
    rows = [{"id": "a", "n": 1}, {"id": "b", "n": None}]
    (tmp_path / "x.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "n": 1}\n{oops\n')
    for f in ("x.json", "x.jsonl"):
        assert sorted(map(tuple, S.records(spark, str(tmp_path / f), "id string, n int").collect())) == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string, n int").collect()
    assert [r["_corrupt_record"] for r in S.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string, n int", strict=False).cache().where("_corrupt_record is not null").collect()] == ["{oops"]
    assert S.optional(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert S.batches(spark, [str(tmp_path / "x.jsonl")], "id string, n int", [2]).count() == 2
    with pytest.raises(ValueError, match="not 3"):
        S.batches(spark, [str(tmp_path / "x.jsonl")], "id string, n int", [3])


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿id,text\r\n1,\"a \"\"b\"\"\nc\"\r\n2,\r\n".encode())
    df = S.csv(spark, str(tmp_path / "x.csv"), ["id", "text"])
    assert sorted((r["id"], r["text"]) for r in df.collect()) == [("1", 'a "b"\nc'), ("2", None)]
    with pytest.raises(ValueError, match="no column"):
        S.csv(spark, str(tmp_path / "x.csv"), ["other"])
    (tmp_path / "y.csv").write_text("a,b,c\nx,y\n")
    assert [r["value"] for r in S.third_field(spark, str(tmp_path / "y.csv")).collect()] == ["c"]
    (tmp_path / "m.txt").write_text("k=v\nnone\n")
    assert [tuple(r) for r in S.mapping(spark, str(tmp_path / "m.txt"), "=").collect()] == [("k", "v")]


def test_pages(spark, tmp_path):
    for p in (1, 2):
        (tmp_path / f"page-{p}.jsonl").write_text("".join(json.dumps({"id": f"{p}-{i}", "name": "n"}) + "\n" for i in range(3)))
    S.register_pages(spark)
    read = lambda quota: spark.read.format("pages").option("path", str(tmp_path)).option("pagesize", "3").option("quota", quota).load()
    assert read("100").count() == 6 and sorted(r["id"] for r in read("4").collect()) == ["1-0", "1-1", "1-2", "2-0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "run"), (2, "b", "review")], "pos int, id string, event_type string")
    S.append_events(df, str(tmp_path / "e"))
    S.append_events(df.limit(1), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).groupBy("event_type").count().count() == 2
    S.write_report(df.groupBy().count(), df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).first()["count"] == 2
    new = S.upsert_range(df, df.withColumn("id", F.lit("z")), "pos", 2, 5)
    assert sorted(r["id"] for r in new.collect()) == ["a", "z"]
    assert S.export_events(df).first()[0].startswith('{"pos":1')
    assert S.sitemap(df, "https://x.test", "id").first()[0] == "https://x.test/a"
    e = S.with_expiry(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as c"), "c").first()["expires_at"]
    assert str(e) == "2024-01-31 00:00:00"


def test_replay(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, id string")
    score = plugins.Replay(spark.createDataFrame([(1, "a", 0.5)], "query_id int, id string, score double"), ["query_id", "id"])
    assert sorted((r["id"], r["score"]) for r in score(pairs).collect()) == [("a", 0.5), ("b", None)]


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(src))
    stream = lambda: E.read(spark, str(src), schema, files=1)
    E.run(stream(), str(tmp_path / "c1"), mode="update", each=E.latest_into(str(tmp_path / "t"), ["user_id"], "ts", "event_id"))
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "t/v2")).collect()}
    want = {r["user_id"]: r["e"] for r in spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
    E.run(E.once(stream(), "event_id", "40 days"), str(tmp_path / "c2"), name="once_rows")
    assert spark.table("once_rows").count() == spark.read.parquet(str(src)).select("event_id").distinct().count()
    E.run(E.sessions(stream(), "user_id", "40 days", "1 hour"), str(tmp_path / "c3"), mode="complete", name="session_rows")
    assert spark.table("session_rows").agg(F.sum("n")).first()[0] == spark.read.parquet(str(src)).count()


def test_manifest_and_new_tables(spark, tmp_path):
    import hashlib

    from mirthlake.sources import readers

    (tmp_path / "f" / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt"):
        (tmp_path / "f" / name).write_bytes(name.encode())
    right = [(n, hashlib.sha256(n.encode()).hexdigest()) for n in ("a.txt", "sub/b.txt")]
    manifest = spark.createDataFrame([right[0], (right[1][0], "0"), ("c.txt", "1")], "path string, sha256 string")
    got = {tuple(r) for r in readers.manifest_mismatches(spark, str(tmp_path / "f"), manifest).collect()}
    assert got == {("sub/b.txt", "changed"), ("c.txt", "missing")}
    readers.write_new(manifest, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_new(manifest, str(tmp_path / "t"))
