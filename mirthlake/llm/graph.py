"""Connected components over an edge table, without bringing links or components to the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names. Only a local session, as in tests, may name none and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mirthlake-"))


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint() of df, without the shuffle files that led to it: they are removed as soon as it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each node's component. Alternating large-star and small-star rounds.

    A hub's neighbours are joined to the hub's minimum, never to each other. Each round is a checkpoint().
    """
    shared_folder(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v"), F.col("v"))).distinct()
