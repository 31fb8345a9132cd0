"""Streams: the batch functions inside foreachBatch, windowed counts, and deduplication with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_batch: int = 10_000) -> DataFrame:
    """Messages of a topic; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_batch).load()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; works on streams and tables alike."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    rows = events.groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("starts"), key, "n", "total")


def first_of_each(events: DataFrame, keys: list[str], at: str, late: str = "2 hours") -> DataFrame:
    """One row per key; on a stream, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes through work; all that is there, then it ends. A batch that fails is tried again, not lost."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_in_order(outputs: list[tuple[str, Callable[[], None]]]) -> list[str]:
    """Sends outputs one after the other; an error keeps the later ones from being sent."""
    done = []
    for name, send in outputs:
        send()
        done.append(name)
    return done
