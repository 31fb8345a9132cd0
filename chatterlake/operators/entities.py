"""Entity candidates, their resolution against aliases, and clusters of what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut


def candidates(text: Column) -> Column:
    """Handles, hashtags and capitalized phrases of one to four words, each surface once, eight at most."""
    handles = F.transform(T.every(text, r"@[\p{L}\p{N}_.]{2,}"), lambda x: F.struct(x.alias("surface"), F.lit("handle").alias("kind")))
    tags = F.transform(T.every(text, r"#[\p{L}\p{N}_]{3,}"), lambda x: F.struct(x.alias("surface"), F.lit("hashtag").alias("kind")))
    names = F.transform(F.filter(T.every(text, r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+){0,3}"), lambda x: F.length(x) >= 3), lambda x: F.struct(x.alias("surface"), F.lit("name").alias("kind")))
    return F.slice(F.array_distinct(F.concat(handles, tags, names)), 1, 8)


def guessed_type(surface: Column) -> Column:
    return F.when(surface.startswith("@"), "person").when(F.size(F.split(surface, " ")) >= 2, "organization").otherwise("unknown")


def specificity(surface: Column) -> Column:
    """How telling a surface is: its length and words, each saturating."""
    return F.round(0.6 * F.least(F.length(surface) / 20, F.lit(1.0)) + 0.4 * F.least(F.size(F.split(surface, " ")) / 3, F.lit(1.0)), 4)


def alias_index(entities: DataFrame) -> DataFrame:
    """alias -> entity_id from names and aliases of entities (entity_id, name, aliases, ord); the last one wins."""
    every = entities.select("entity_id", "ord", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    return every.groupBy(T.alias(F.col("a")).alias("alias")).agg(F.max_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id")).filter("alias != ''")


def resolved(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hits (mention_id, surface) with entity_id, confidence and method; what no alias names stays unresolved.

    Whether the index is broadcast is Spark's choice, by its measured size.
    """
    rows = hits.withColumn("alias", T.alias(F.col("surface"))).join(index, "alias", "left")
    found = F.col("entity_id").isNotNull()
    return rows.withColumns({"confidence": F.when(found, 0.78).otherwise(0.40), "method": F.when(found, "alias").otherwise("unresolved"), "reason": F.when(~found, "no_alias_match")})


def text_scan(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """mention_id, entity_id of every alias whose words stand in the text: an equi-join on runs of words, not a scan of all pairs."""
    named = index.select(F.array_join(T.words(F.lower(F.col("alias"))), " ").alias("alias"), "entity_id").filter("length(alias) >= 2")
    longest = named.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1  # words of the longest alias

    def runs(tokens: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(tokens) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))))

    grams = mentions.select("mention_id", F.explode(F.array_distinct(T.let(T.words(F.lower(F.col("text"))), runs))).alias("alias"))
    return grams.join(named, "alias").select("mention_id", "entity_id").distinct()


def unresolved_clusters(hits: DataFrame, least: int = 2, examples: int = 5) -> DataFrame:
    """surface (normalized), mentions, hits and first mentions of unresolved surfaces that occur at least `least` times."""
    rows = hits.filter("entity_id is null")
    found = rows.groupBy("alias").agg(F.count_distinct("mention_id").alias("mentions"), F.count("*").alias("hits"), F.min("mention_id").alias("first_mention")).filter(F.col("mentions") >= least)
    return found.withColumn("cluster_id", F.concat(F.lit("cand:"), F.substring(F.md5("alias"), 1, 12)))


def taxonomy(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id, depth, path of a taxonomy, from its roots down to any depth; nodes out of reach, as in a cycle, have a null depth.

    A node that several rows name counts at its first level; a level only holds nodes not met before, so the walk ends.
    """
    level = cut(nodes.filter("parent_id is null").groupBy("node_id").agg(F.lit(0).alias("depth"), F.min(F.col("node_id").cast("string")).alias("path")))
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"))
        below = nodes.join(up, "parent_id").join(found.select("node_id"), "node_id", "left_anti")
        level = cut(below.groupBy("node_id").agg(F.lit(depth).alias("depth"), F.min(F.concat_ws("/", "up_path", "node_id")).alias("path")))
        found = found.union(level)
    return nodes.select("node_id", "parent_id").join(found, "node_id", "left")


def dangling(children: DataFrame, reference: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing in parents: a valid ontology has none."""
    return children.filter(F.col(reference).isNotNull()).join(parents.select(F.col(key).alias(reference)), reference, "left_anti")


def overlay(base: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Rows of both layers, the upper one's where both have a key; of a layer's rows with one key, the last holds."""
    at = F.monotonically_increasing_id()
    both = base.withColumns({"_layer": F.lit(0), "_at": at}).unionByName(above.withColumns({"_layer": F.lit(1), "_at": at}))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_layer"), F.desc("_at")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_layer", "_at", "_rank")
