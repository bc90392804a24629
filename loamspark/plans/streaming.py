"""Batch twins of the stateful operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamspark.plans.registry import query
from loamspark.plans.tables import read
from loamspark.streaming import gates


def _requests(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("token_bucket")
def token_bucket(spark, d):
    return gates.rate_limit(_requests(spark, d), "token_bucket", rate=1 / 3600, capacity=3)


@query("sliding_log")
def sliding_log(spark, d):
    return gates.rate_limit(_requests(spark, d), "sliding_log", limit=2, seconds=3600.0)


@query("fixed_window_limiter")
def fixed_window_limiter(spark, d):
    return gates.rate_limit(_requests(spark, d), "fixed_window", limit=2, seconds=3600.0)


@query("entropy_gate")
def entropy_gate(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return gates.novelty_gate(rows.select(F.col("label").cast("long").alias("key"), F.col("doc_id").alias("id"), "text", "embedding"), threshold=0.2)


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return gates.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("incremental_index", "SELECT user_id AS entity, event_type AS action, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL")
def incremental_index(spark, d):
    return gates.incremental_index(read(spark, d, "events"))
