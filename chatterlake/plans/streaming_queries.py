"""Streaming queries: the stream runs to its end and what it left is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import events as E
from . import adapters as A
from .registry import listing

QUERIES, ORACLE_SQL, query = listing()


def drained(spark, frame, mode):
    """The result table of a stream that has read all its input."""
    name = f"stream_{uuid.uuid4().hex}"
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def event_stream(spark, sf_dir):
    schema = A.table(spark, sf_dir, "events").schema
    rows = E.file_stream(spark, sf_dir, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS starts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark, sf_dir):
    found = drained(spark, E.windowed_counts(event_stream(spark, sf_dir), "ts", "event_type"), "complete")
    return found.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    first = E.first_of_each(event_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")
    return drained(spark, first, "append").groupBy("event_type").agg(F.count("*").alias("users"))
