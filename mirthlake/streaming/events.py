"""Events as streams: latest row a key, counts, duplicates and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import latest


def read(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1000, pattern: str = "*.parquet") -> DataFrame:
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


class LatestTable:
    """For foreachBatch: a table of the latest row a key, a version a batch; a batch that is repeated writes the same.

    Only the last version and the one before it are needed; read() gives the last one written.
    """

    def __init__(self, path: str, keys: list[str], time: str, tie: str) -> None:
        self.path, self.keys, self.time, self.tie, self.version = path, keys, time, tie, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = latest(batch, self.keys, self.time, self.tie)
        if number > 0:
            new = latest(new.unionByName(batch.sparkSession.read.schema(new.schema).parquet(f"{self.path}/v{number - 1}")), self.keys, self.time, self.tie)
        new.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        self.version = number

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{self.version}")


def latest_into(path: str, keys: list[str], time: str, tie: str) -> LatestTable:
    return LatestTable(path, keys, time, tie)


def updates_into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in update mode: the changed rows of each batch, a folder a batch, none on the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def last_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def counted(df: DataFrame, by: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows, rows later than delay left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.withWatermark("ts", delay).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, by: str, delay: str, gap: str) -> DataFrame:
    return df.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))


def once(df: DataFrame, key: str, delay: str) -> DataFrame:
    """Each key once, within the delay that deliveries may be apart."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run(df: DataFrame, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, name: str | None = None) -> None:
    """All that is there, then stop. A name in place of each keeps the result in the driver's memory, for a look at small ones."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("memory").queryName(name)
    w.start().awaitTermination()
