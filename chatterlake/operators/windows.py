"""Chronological halves and bursts, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holding(counts: DataFrame, unit: str, wanted: Column) -> DataFrame:
    """One row: the unit (of counts: unit, n) that holds the wanted-th row in order of units, and its place in there (from 1); none if wanted is 0."""
    running = Window.orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.select(unit, "n", F.sum("n").over(running).alias("upto")).withColumn("wanted", wanted)
    return rows.filter("upto >= wanted and upto - n < wanted").select(F.col(unit).alias("held"), (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("place"))


def half_split(rows: DataFrame, at: str, row_id: str) -> DataFrame:
    """rows with `half`: previous for the first n // 2 by (at, row_id), current for the rest; null if at is null or n < 2.

    The cut is found from counts per day, then per second of its day; only the rows of its
    second are ranked, so no task sorts all rows.
    """
    dated = rows.filter(F.col(at).isNotNull()).select(at, row_id, F.to_date(at).alias("day"), F.date_trunc("second", at).alias("second"))
    half = dated.select(F.floor(F.count("*") / 2)).scalar()
    day = holding(dated.groupBy("day").agg(F.count("*").alias("n")), "day", half)
    in_day = dated.join(F.broadcast(day), F.col("day") == F.col("held")).drop("held")
    second = holding(in_day.groupBy("second").agg(F.count("*").alias("n")), "second", day.select("place").scalar())
    in_second = in_day.drop("place").join(F.broadcast(second), F.col("second") == F.col("held"))
    rank = F.row_number().over(Window.orderBy(at, row_id))
    last = in_second.withColumn("rank", rank).filter("rank = place")
    # The last row of the previous half, one or none: as a scalar it needs no join.
    edge = last.select(F.struct(F.col(at).alias("at"), F.col(row_id).alias("id"))).scalar()
    previous = F.struct(F.col(at).alias("at"), F.col(row_id).alias("id")) <= F.col("_edge")
    return rows.withColumn("_edge", edge).withColumn(
        "half", F.when(F.col(at).isNull() | F.col("_edge").isNull(), F.lit(None)).when(previous, "previous").otherwise("current")).drop("_edge")


def half_bounds(split: DataFrame, at: str) -> DataFrame:
    """half, first and last time, and number of rows of each half."""
    return split.filter("half is not null").groupBy("half").agg(F.min(at).alias("starts"), F.max(at).alias("ends"), F.count("*").alias("mentions"))


def burstiness(rows: DataFrame, author: str, at: str, minutes: int = 60) -> DataFrame:
    """author, posts and burstiness: the largest share of posts within any `minutes`; 0 for fewer than two."""
    within = Window.partitionBy(author).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-60 * minutes, 0)
    counted = rows.filter(F.col(at).isNotNull()).select(author, F.count("*").over(within).alias("_n"))
    return counted.groupBy(author).agg(
        F.count("*").alias("posts"),
        F.when(F.count("*") < 2, 0.0).otherwise(F.round(F.max("_n") / F.count("*"), 4)).alias("burstiness"))


def first_rows(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """group and `first`, the k smallest different values of it. Spark limits the ranks before the shuffle: no task gathers a whole group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    best = rows.select(group, value).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return best.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("first"))
