"""The test tables as the engine's own: mentions, threads, timed facts and entity hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores dealt out to all cores; larger tables as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as mentions: author and platform are the source."""
    raw = spread(table(spark, sf_dir, "documents"))
    rows = raw.select(F.col("doc_id").alias("mention_id"), F.col("source").alias("author_id"), F.col("source").alias("platform"), "lang", T.squeeze(F.col("text")).alias("text"), F.lit(0).alias("depth"), T.compact(F.col("text")).alias("compact"))
    return rows.withColumns({"urls": T.urls(F.col("text")), "hashtags": T.hashtags(F.col("text")), "normalized": F.col("text")})


def thread_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as threads: the first turn is the root, each turn answers the one before."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    return rows.select(
        name(F.col("turn")).alias("origin_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), F.col("conv_id").cast("string").alias("root_id"),
        F.least("turn", F.lit(2)).alias("depth"), F.col("role").alias("author_id"), F.length("text").alias("sort_score"), "text")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed mentions."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("mention_id"), F.col("user_id").alias("author_id"), F.col("ts").alias("posted_at"), F.col("event_type").alias("topic"), "value", "props")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated mentions with a weight."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderdate").alias("posted_at"), F.when(F.col("o_orderpriority").startswith("1"), 0.5).otherwise(1.0).alias("weight"))


def brand_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits of their part's brand: mention_id, entity_id."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("mention_id"), F.col("p_brand").alias("entity_id"))
