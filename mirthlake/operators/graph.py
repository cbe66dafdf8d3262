"""Connected groups by contraction of edges, checkpointed each round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names. Only a local session, as in tests, may name none and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mirthlake-"))


def groups(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): the least node of each connected group.

    Each round maps every node to its least neighbour's least neighbour and the edges with them; edges within a node and
    repeated ones fall away, so what the next round reads shrinks until no edge is left.
    """
    checkpoints(edges.sparkSession)
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).checkpoint()
    labels = None
    while True:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        near = e.select(F.inline(both)).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        step = near.join(near.toDF("p", "far"), "p").select(F.col("a").alias("node"), F.col("far").alias("root")).checkpoint()
        labels = step if labels is None else labels.join(step.toDF("root", "far"), "root", "left").select("node", F.coalesce("far", "root").alias("root")).checkpoint()
        moved = e.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        e = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
        if e.isEmpty():
            return labels
