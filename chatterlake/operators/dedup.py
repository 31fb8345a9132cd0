"""Exact and near duplicates of mentions, their clusters, representatives and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import Stored, cut

#: Similarity of near duplicates, on the value rounded to four digits.
SIMILAR = 0.82


def fingerprint(compact: Column) -> Column:
    """Hash of the compact text; none for texts shorter than ten characters."""
    return F.when(F.length(compact) >= 10, F.sha2(compact, 256))


def representative(length: Column) -> Column:
    """An aggregate: the longest text's mention, then the shallowest, then the first."""
    return F.min(F.struct((-length).alias("a"), F.col("depth").alias("b"), F.col("mention_id").alias("c")))["c"]


def exact_clusters(mentions: DataFrame) -> DataFrame:
    """cluster_id, cluster_size, representative of each fingerprint that two or more mentions share."""
    marked = mentions.withColumn("_print", fingerprint(F.col("compact"))).filter("_print is not null")
    groups = marked.groupBy("_print").agg(F.count("*").alias("cluster_size"), representative(F.length("compact")).alias("representative_id")).filter("cluster_size >= 2")
    return groups.select(F.concat(F.lit("exact:"), F.substring("_print", 1, 16)).alias("cluster_id"), "cluster_size", "representative_id", "_print")


def exact_members(mentions: DataFrame) -> DataFrame:
    marked = mentions.select("mention_id", fingerprint(F.col("compact")).alias("_print"))
    return marked.join(exact_clusters(mentions), "_print").select("mention_id", "cluster_id", "cluster_size", "representative_id")


def copied(mentions: DataFrame) -> DataFrame:
    """mention_id of the members of exact clusters, from one reading of the texts."""
    marked = mentions.select("mention_id", fingerprint(F.col("compact")).alias("_print")).filter("_print is not null")
    return marked.withColumn("_size", F.count("*").over(Window.partitionBy("_print"))).filter("_size >= 2").select("mention_id")


def rare_first(mentions: DataFrame, floor: float, store: Stored) -> DataFrame:
    """mention_id, n, x, left and least: a row for each shingle that a set is listed under, what is left of its list from there on, and what similar sets share.

    A set has at most d = n - ceil(n * floor) shingles that a similar one lacks. So the 2 d + 1 first shingles of both, in
    the order of their names, share d + 1 at least, by the smaller set's d: only those are counted, a third of all. A set
    of which fewer occur elsewhere is like no other. The rest is listed under its rarest ones, as many as similar sets
    can't avoid sharing; those that occur once meet nobody and only count as places.
    """
    lacking = lambda n: n - F.ceil(n * floor)
    shared = lambda n: F.least(n, 2 * lacking(n) + 1) - lacking(n)
    n = F.col("n")
    names = mentions.select("mention_id", T.shingle_names(F.col("compact")).alias("h")).select("mention_id", F.size("h").alias("n"), F.sort_array("h").alias("h"))
    first = names.select("mention_id", "n", F.slice("h", F.lit(1), F.least(n, 2 * lacking(n) + 1).cast("int")).alias("h"))
    # Outer: Spark would compute the sets once more to leave empty ones out.
    each = first.select("mention_id", "n", F.explode_outer("h").alias("x")).filter("x is not null")
    often = store.write(each.withColumn("df", F.count("*").over(Window.partitionBy("x")).cast("int")).filter("df > 1"))
    own = Window.partitionBy("mention_id")
    rows = often.withColumn("r", F.row_number().over(own.orderBy("df", "x"))).withColumn("m", F.count("*").over(own))
    rows = rows.select("mention_id", "n", "x", (F.col("m") - F.col("r") + 1).cast("int").alias("left"), shared(F.ceil(n * floor)).cast("int").alias("least"))
    return rows.filter(F.col("left") >= F.col("least"))


def near_pairs(mentions: DataFrame, least: float = SIMILAR, without: DataFrame | None = None) -> DataFrame:
    """a < b and similarity of all pairs with Jaccard similarity of at least `least`, by prefix filtering.

    Shingles are 64-bit names. Only sets that meet under a listed one, have fitting sizes and enough of their lists left
    from that place on are compared, in full. Mentions in `without` (mention_id) take no part.
    """
    floor = least - 0.00006  # the test is on four digits
    store = Stored(mentions)
    rows = rare_first(mentions, floor, store)
    posted = store.write(rows.join(without, "mention_id", "left_anti") if without is not None else rows)
    store.drop(1)
    left, right = (posted.select("x", F.col("mention_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "left", "least")]) for k in "ab")
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * floor
    enough = F.least("left_a", "left_b") >= F.greatest("least_a", "least_b")
    pairs = store.write(left.join(right, "x").filter((F.col("a") < F.col("b")) & fits & enough).select("a", "b").distinct())
    store.drop(2)
    # The same joins at every size: texts and sets are too many to be looked up in one table.
    involved = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "mention_id").hint("merge")
    sets = store.write(mentions.select("mention_id", "compact").join(involved, "mention_id", "left_semi").select("mention_id", T.shingle_names(F.col("compact")).alias("h")))
    side = lambda k: sets.select(F.col("mention_id").alias(k), F.col("h").alias(f"h_{k}")).hint("merge")
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", T.shared_share(F.col("h_a"), F.col("h_b")).alias("similarity"))
    return scored.filter(F.col("similarity") >= least)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node and component (smallest reachable node) of edges (a, b); lineage is cut each round, in the checkpoint folder."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    for _ in range(rounds):
        offers = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        lowered = labels.join(offers, "node").select("node", F.least("component", "offer").alias("component"))
        up = lowered.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = cut(lowered.join(up, "component", "left").select("node", F.least("component", "up").alias("component")))
        moved = after.join(labels.withColumnRenamed("component", "was"), "node").filter("component < was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise ValueError(f"components did not settle in {rounds} rounds")


def near_clusters(mentions: DataFrame, least: float = SIMILAR) -> DataFrame:
    """mention_id, cluster_id, cluster_size, representative_id, similarity (mean of the cluster's linked pairs).

    Members of exact clusters take no part.
    """
    pairs = Stored(mentions).write(near_pairs(mentions, least, copied(mentions)))
    found = components(pairs.select("a", "b"))
    # Only lengths travel to the join.
    members = mentions.select("mention_id", "depth", F.length("compact").alias("length")).join(found.withColumnRenamed("node", "mention_id"), "mention_id")
    groups = members.groupBy("component").agg(F.count("*").alias("cluster_size"), representative(F.col("length")).alias("representative_id"))
    means = pairs.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.round(F.avg("similarity"), 4).alias("similarity"))
    cluster = F.concat(F.lit("near:"), F.substring(F.sha2(F.col("component").cast("string"), 256), 1, 16))
    return members.select("mention_id", "component").join(groups, "component").join(means, "component").select(
        "mention_id", cluster.alias("cluster_id"), "cluster_size", "representative_id", "similarity")


def annotated(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mentions with dedup_cluster_id, dedup_kind, dedup_cluster_size and dedup_weight (1 / size, six digits)."""
    found = clusters.select("mention_id", F.col("cluster_id").alias("dedup_cluster_id"), F.col("cluster_size").alias("dedup_cluster_size"))
    out = mentions.join(found, "mention_id", "left")
    size = F.coalesce("dedup_cluster_size", F.lit(1))
    return out.withColumns({"dedup_kind": F.substring_index("dedup_cluster_id", ":", 1), "dedup_cluster_size": size, "dedup_weight": F.round(1 / size, 6)})
