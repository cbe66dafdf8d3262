"""Readers and writers for the file formats of the catalogue, its events and its reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A record a line, blank lines skipped. Not strict: broken lines come as nulls with their text in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """By extension: .jsonl a record a line, anything else one array."""
    return json_lines(spark, path, schema) if path.endswith(".jsonl") else json_array(spark, path, schema)


def optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As records(), but a missing file is an empty table."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    return records(spark, path, schema)


def csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Quoted CSV with a header; doubled quotes, byte-order marks and line breaks inside quotes are read. Fails without a required column."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {missing}")
    return df


def third_field(spark: SparkSession, path: str) -> DataFrame:
    """(value): the third of plain comma-separated fields, for files without quotes."""
    return spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(3)).alias("value")).where("value <> ''")


def mapping(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(key, value) of lines with one separator."""
    return spark.read.text(path).where(F.contains("value", F.lit(separator))).select(F.split_part("value", F.lit(separator), F.lit(1)).alias("key"), F.split_part("value", F.lit(separator), F.lit(2)).alias("value"))


def batches(spark: SparkSession, paths: list[str], schema: T.StructType | str, expected: list[int]) -> DataFrame:
    """Several files as one table, each with the number of rows it must have."""
    df = json_lines(spark, paths, schema)
    found = {r["f"]: r["n"] for r in df.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
    for p, n in zip(paths, expected):
        if found.get(os.path.basename(p), 0) != n:
            raise ValueError(f"{p} has {found.get(os.path.basename(p), 0)} rows, not {n}")
    return df


def events(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """One event a file, in order of time and id."""
    return spark.read.schema(schema).option("pathGlobFilter", pattern).option("multiLine", True).json(folder).orderBy("timestamp", "id")


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def register_pages(spark: SparkSession) -> None:
    """The source "pages": numbered JSON-lines files page-1.jsonl, page-2.jsonl, ... of a folder, one partition a page, until one is missing or empty or the quota is full."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder, self.quota, self.size = options["path"], int(options.get("quota", "1000000000")), int(options.get("pagesize", "100"))

        def partitions(self):
            out = []
            while len(out) * self.size < self.quota and os.path.exists(p := f"{self.folder}/page-{len(out) + 1}.jsonl") and os.path.getsize(p):
                out.append(InputPartition(len(out) + 1))
            return out

        def read(self, partition):
            with open(f"{self.folder}/page-{partition.value}.jsonl") as f:
                for i, line in enumerate(f):
                    if line.strip() and (partition.value - 1) * self.size + i < self.quota:
                        r = json.loads(line)
                        yield (partition.value, r.get("id"), r.get("name"))

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "pages"

        def schema(self):
            return "page int, id string, name string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Pages)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A report twice: its rows, and a summary without them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def append_events(df: DataFrame, path: str) -> None:
    """Append only, a folder an event type."""
    df.write.mode("append").partitionBy("event_type").parquet(path)


def with_expiry(df: DataFrame, created: str, days: int = 30) -> DataFrame:
    return df.withColumn("expires_at", F.col(created) + F.make_dt_interval(F.lit(days)))


def upsert_range(old: DataFrame, new: DataFrame, pos: str, start: int, limit: int) -> DataFrame:
    """Rows of a range of positions replaced by the new ones of that range; limit is 500 at most."""
    inside = F.col(pos).between(start, start + min(limit, 500) - 1)
    return old.where(~inside).unionByName(new.where(inside))


def sitemap(df: DataFrame, base: str, id_: str) -> DataFrame:
    return df.select(F.concat(F.lit(base), F.lit("/"), F.col(id_)).alias("url"))


def export_events(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def manifest_mismatches(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, fault) of a manifest (path relative to folder, sha256): files that are missing or have another content. Files are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    own = files.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("path"), F.sha2("content", 256).alias("found"))
    both = manifest.join(own, "path", "left")
    return both.where("found is null or found <> sha256").select("path", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("fault"))


def write_new(df: DataFrame, path: str) -> None:
    """A table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)
