"""Queries: events, experiments, retention and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators.dedup import latest
from ..streaming import events as S
from .common import t


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return latest(t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts", "value", F.from_json("props", "k int")["k"].alias("k"))


LATEST_SQL = "SELECT user_id, event_type, event_id, ts, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1"


def ttl_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Parents expire ten days after they were made; children go with them."""
    e = t(spark, d, "events").withColumn("expires_at", F.col("ts") + F.make_dt_interval(F.lit(10)))
    parents, children = C.retained(e.where("event_type = 'view'").select("user_id", "expires_at"), e.where("event_type = 'click'"), "user_id", "expires_at", F.lit("2024-01-25").cast("timestamp_ntz"))
    return parents.agg(F.count("*").alias("n_parents")).join(children.agg(F.count("*").alias("n_children"), F.count_distinct("user_id").alias("n_users")))


TTL_SQL = """
WITH p AS (SELECT user_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 10 DAYS > TIMESTAMP '2024-01-25')
SELECT (SELECT count(*) FROM p) AS n_parents, count(*) AS n_children, count(DISTINCT user_id) AS n_users FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM p)"""


def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Conditions with counters, guarded rates and a lower median."""
    e = t(spark, d, "events")
    rate = F.coalesce(F.try_divide(F.count_if(F.col("value") > 20).cast("double"), F.count("*")), F.lit(0.0))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") > 20).alias("n_high"), F.count_if(F.col("value").isNull()).alias("n_null"), (F.floor(rate * 1e6 + 0.5) / 1e6).alias("high_rate"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("lower_median"))


EXPERIMENT_SQL = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 20) AS n_high, count(*) FILTER (WHERE value IS NULL) AS n_null, floor(CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS high_rate, quantile_disc(value, 0.5) AS lower_median FROM events GROUP BY event_type"


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Arms of each experiment with their run and latest review; complete when every run succeeded and is reviewed."""
    e = t(spark, d, "events")
    arms = e.select("user_id", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("arm")).distinct()
    runs = latest(e.where("event_type in ('view', 'click')").select("user_id", F.col("event_type").alias("arm"), "ts", "event_id"), ["user_id", "arm"], "ts", "event_id")
    reviews = latest(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id").select("user_id", F.col("value").alias("verdict"))
    q = arms.join(runs, ["user_id", "arm"], "left").join(reviews, "user_id", "left").withColumn("status", F.when(F.col("event_id").isNull(), "error").otherwise("ok"))
    return q.groupBy("user_id").agg(F.bool_and((F.col("status") == "ok") & F.col("verdict").isNotNull()).alias("complete"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "arm", "status", F.col("event_id").cast("string")))), ",").alias("arms"))


QUEUE_SQL = """
WITH a AS (SELECT DISTINCT user_id, arm FROM events, (VALUES ('view'), ('click')) v(arm)),
  r AS (SELECT user_id, event_type AS arm, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
  w AS (SELECT user_id, arg_max(value, (ts, event_id)) AS verdict FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  q AS (SELECT a.user_id, a.arm, event_id, verdict, CASE WHEN event_id IS NULL THEN 'error' ELSE 'ok' END AS status FROM a LEFT JOIN r USING (user_id, arm) LEFT JOIN w USING (user_id))
SELECT user_id, bool_and(status = 'ok' AND verdict IS NOT NULL) AS complete, array_to_string(list_sort(list(concat_ws(':', arm, status, CAST(event_id AS VARCHAR)))), ',') AS arms FROM q GROUP BY user_id"""


def _folder(spark: SparkSession) -> str:
    """A folder of our own for a stream's state: in the cluster's shared folder if it names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="mirthlake-stream-")


def _stream(spark, d):
    return S.read(spark, d, t(spark, d, "events").schema, pattern="events.parquet")


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each key by a stream that upserts in batches."""
    at = _folder(spark)
    table = S.latest_into(f"{at}/table", ["user_id", "event_type"], "ts", "event_id")
    S.run(_stream(spark, d), f"{at}/state", mode="update", each=table)
    return table.read(spark).select("user_id", "event_type", "event_id", "value")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by a stream in update mode, the last state of each window."""
    at = _folder(spark)
    S.run(S.counted(_stream(spark, d), "event_type", "1 hour", "1 day"), f"{at}/state", mode="update", each=S.updates_into(f"{at}/windows"))
    w = S.last_updates(spark, f"{at}/windows", ["window", "event_type"])
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))


QUERIES = {f.__name__: f for f in (latest_per_key, ttl_cascade, experiment_summary, review_queue, stream_latest, stream_counts)}
SQL = {
    "latest_per_key": LATEST_SQL,
    "ttl_cascade": TTL_SQL,
    "experiment_summary": EXPERIMENT_SQL,
    "review_queue": QUEUE_SQL,
    "stream_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1",
    "stream_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL",
}
