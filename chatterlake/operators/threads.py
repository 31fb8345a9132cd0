"""Threads: edges, lineage, siblings, summaries and controversy. `key` names the id that parents and roots refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .lineage import cut


def edges(mentions: DataFrame, key: str = "origin_id") -> DataFrame:
    """src (parent), dst, depth of every mention whose parent is there."""
    parents = mentions.select(F.col(key).alias("src")).distinct()
    return mentions.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col(key).alias("dst"), "depth").join(parents, "src", "left_semi")


def lineage(mentions: DataFrame, key: str = "origin_id") -> DataFrame:
    """Ancestors of each mention, the root first. Walks double their reach each round until each is at its root; one that meets an id again ends there."""
    nodes = mentions.select(F.col(key).alias("id"), F.col("parent_id").alias("up"))
    known = nodes.select("id").distinct()
    parents = nodes.groupBy("id").agg(F.min("up").alias("up"))
    # near: ancestors from the nearest on; top: the last of them, null when there are no more.
    state = cut(parents.join(known.withColumnRenamed("id", "up"), "up", "left_semi").select("id", F.array("up").alias("near"), F.col("up").alias("top")))
    while not state.filter("top is not null").isEmpty():
        above = state.select(F.col("id").alias("top"), F.col("near").alias("more"), F.col("top").alias("next"))
        walked = state.join(above, "top", "left").select("id", "next", F.concat("near", F.coalesce("more", F.array().cast("array<string>"))).alias("walk"))
        once = walked.withColumn("near", F.array_remove(F.array_distinct("walk"), F.col("id")))
        state = cut(once.select("id", "near", F.when(F.size("near") == F.size("walk"), F.col("next")).alias("top")))
    return nodes.select("id").join(state.select("id", F.reverse("near").alias("path")), "id", "left").select("id", F.coalesce("path", F.array().cast("array<string>")).alias("lineage"))


def siblings(mentions: DataFrame, key: str = "origin_id") -> DataFrame:
    """id, parent, number of other children of the parent, number of own children."""
    children = mentions.filter("parent_id is not null").groupBy(F.col("parent_id").alias("p")).agg(F.count("*").alias("n"))
    rows = mentions.select(F.col(key).alias("id"), "parent_id")
    rows = rows.join(children, rows["parent_id"] == children["p"], "left").select("id", "parent_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("siblings"))
    return rows.join(children.select(F.col("p").alias("id"), F.col("n").alias("children")), "id", "left").fillna({"children": 0})


def summaries(mentions: DataFrame, key: str = "origin_id", top: int = 5) -> DataFrame:
    """Per root: mentions, deepest depth, comments (depth 1), replies (deeper) and the `top` comments by score."""
    counts = mentions.groupBy("root_id").agg(
        F.count("*").alias("total_mentions"), F.max("depth").alias("max_depth_observed"), F.count_if(F.col("depth") == 1).alias("comment_count"), F.count_if(F.col("depth") >= 2).alias("reply_count"))
    order = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("sort_score"), "depth", key)
    best = mentions.filter("depth > 0").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top)
    best = best.groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(key).alias("id")))), lambda x: x["id"]).alias("top_comment_ids"))
    return counts.join(best, "root_id", "left").withColumn("top_comment_ids", F.coalesce("top_comment_ids", F.array().cast("array<string>")))


def controversy(summary: DataFrame, mentions: DataFrame, sentiments: DataFrame, issues: DataFrame) -> DataFrame:
    """Per root: five proxies and the controversy score. sentiments: root_id, sentiment; issues: root_id, issue_category."""
    authors = mentions.groupBy("root_id").agg(F.countDistinct("author_id").alias("_authors"))
    moods = sentiments.groupBy("root_id").agg(F.count_if(F.col("sentiment") == "positive").alias("_p"), F.count_if(F.col("sentiment") == "negative").alias("_n"))
    topics = issues.groupBy("root_id").agg(F.countDistinct("issue_category").alias("_kinds"), F.count("*").alias("_issues"))
    rows = summary.join(authors, "root_id", "left").join(moods, "root_id", "left").join(topics, "root_id", "left").fillna(0, ["_authors", "_p", "_n", "_kinds", "_issues"])
    one = F.lit(1)
    rows = rows.select(
        "root_id", "total_mentions",
        ratio(F.col("reply_count"), F.greatest("comment_count", one)).alias("reply_density_proxy"), ratio(F.col("max_depth_observed"), F.greatest("total_mentions", one)).alias("recursion_proxy"),
        (F.least("_p", "_n") / F.greatest(F.col("_p") + F.col("_n"), one)).alias("_mixed"), ratio(F.col("_authors"), F.col("total_mentions")).alias("author_diversity_proxy"),
        ratio(F.col("_kinds"), F.greatest("_issues", one)).alias("issue_diversity_proxy"))
    score = F.col("reply_density_proxy") * 0.28 + F.col("recursion_proxy") * 0.24 + F.col("_mixed") * 0.24 + F.col("author_diversity_proxy") * 0.14 + F.col("issue_diversity_proxy") * 0.10
    return rows.withColumns({"controversy_score_proxy": F.round(F.least(score, F.lit(1.0)), 4), "mixed_sentiment_proxy": F.round("_mixed", 4)}).drop("_mixed")
