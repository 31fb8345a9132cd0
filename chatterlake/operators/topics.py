"""Topic tokens, pairs of mentions that share them, and clusters of those."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import components
from .lineage import Stored, cut

#: Words that say nothing about a topic. Configuration: a small sample.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "you", "les", "des", "une", "que", "est", "der", "die", "und", "das", "los", "las", "cho", "của", "và", "là")
#: Mentions that share the same two tokens meet in blocks of about so many.
BLOCK = 4096


def topic_tokens(text: Column) -> Column:
    """Words of at least three characters that aren't stopwords."""
    return F.filter(T.words(F.lower(text)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))


def top_tokens(mentions: DataFrame, k: int = 8) -> DataFrame:
    """mention_id, token, n, rank: each mention's k most frequent tokens, ties to the earlier one."""
    # Dealt by mention before the tokens are counted: the texts are all that is shuffled.
    each = mentions.select("mention_id", "text").repartition("mention_id").select("mention_id", F.posexplode(topic_tokens(F.col("text"))).alias("at", "token"))
    counted = each.groupBy("mention_id", "token").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = counted.groupBy("mention_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "token"))), 1, k).alias("best"))
    return best.select("mention_id", F.posexplode("best").alias("rank", "b")).select("mention_id", F.col("b.token").alias("token"), (-F.col("b.m")).alias("n"), (F.col("rank") + 1).alias("rank"))


def token_pairs(tops: DataFrame) -> DataFrame:
    """mention_id and two, a row for each two of a mention's top tokens: mentions that share two tokens meet in one such key."""
    sets = tops.groupBy("mention_id").agg(F.array_sort(F.collect_set("token")).alias("t"))
    two = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return sets.select("mention_id", F.explode(two).alias("two"))


def two_and_rest(sets: DataFrame) -> DataFrame:
    """mention_id, two of its sorted top tokens t, x < y, and the others, those before y first, as u."""
    two = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return sets.select("mention_id", "t", F.explode(two).alias("two")).select("mention_id", "two.x", "two.y", F.array_except("t", F.array("two.x", "two.y")).alias("u"))


def sharing_pairs(tops: DataFrame, k: int = 8) -> DataFrame:
    """a < b and shared: all mentions that share at least two of their k top tokens, however frequent those are.

    They meet by two tokens at once, so a frequent token alone brings nobody together, and each pair leaves the join once: at the
    first two tokens that it shares. So nothing that grows with pairs is shuffled or sorted, only the mentions' rows. Those of
    two tokens that many mentions share are dealt in blocks of a. The result holds all pairs of a group; `sharing_links` has
    the same components in rows that grow with the mentions.
    """
    # Tokens go by 63 bits of hash.
    token = F.xxhash64("token").bitwiseAND(F.lit((1 << 63) - 1))
    rows = two_and_rest(Stored(tops).write(tops.groupBy("mention_id").agg(F.array_sort(F.collect_set(token)).alias("t"))))
    rest = [f"u{i}" for i in range(k - 2)]
    large = rows.groupBy("x", "y").count().filter(F.col("count") > BLOCK).select("x", "y", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(large, ["x", "y"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # Numbers that no token has stand for absent ones, another on each side: the comparisons are then plain and compile to little code.
    side = lambda absent: [F.coalesce(F.get("u", F.lit(i)), F.lit(absent)).alias(c) for i, c in enumerate(rest)]
    left = rows.select("mention_id", "x", "y", F.pmod(F.xxhash64("mention_id"), F.col("blocks")).cast("int").alias("block"), *side(-1)).alias("l")
    right = rows.select("mention_id", "x", "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *side(-2)).alias("r")
    col = lambda side, c: F.col(f"{side}.{c}")
    same = [col("l", p) == col("r", q) for p in rest for q in rest]
    earlier = reduce(or_, [col("l", p).isin(*[col("r", q) for q in rest]) & (col("l", p) < col("l", "y")) for p in rest])
    shared = sum((eq.cast("int") for eq in same), F.lit(2))
    keys = [col("l", c) == col("r", c) for c in ("x", "y", "block")]
    met = left.join(right, keys[0] & keys[1] & keys[2] & (col("l", "mention_id") < col("r", "mention_id")) & ~earlier)
    return met.select(col("l", "mention_id").alias("a"), col("r", "mention_id").alias("b"), shared.cast("long").alias("shared"))


def sharing_links(tops: DataFrame) -> DataFrame:
    """a < b whose components are those of all mentions that share two top tokens, however frequent: each mention
    is linked to the smallest one that has the same two tokens, so links grow with mentions, not with their pairs."""
    rows = token_pairs(tops)
    least = rows.groupBy("two").agg(F.min("mention_id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("two", "a")
    return rows.join(least, "two").filter("a < mention_id").select("a", F.col("mention_id").alias("b")).distinct()


def clusters(tops: DataFrame) -> DataFrame:
    """topic_key, label (its three most frequent tokens), mentions, confidence of each group of mentions linked by two top tokens."""
    tops = cut(tops)
    found = components(sharing_links(tops))
    rows = tops.join(found.withColumnRenamed("node", "mention_id"), "mention_id")
    sizes = found.groupBy("component").agg(F.count("*").alias("mentions"))
    terms = rows.groupBy("component", "token").agg(F.sum("n").alias("uses"))
    # The three first of a component by row numbers: Spark limits them before the shuffle, so no task gathers all its terms.
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("uses"), "token"))
    best = terms.withColumn("k", rank).filter("k <= 3").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("best"))
    label = best.select("component", F.transform("best", lambda x: x["token"]).alias("terms")).withColumn("label", F.array_join("terms", " "))
    conf = F.least(0.35 + 0.05 * F.col("mentions"), F.lit(0.85))
    return sizes.join(label, "component").select(F.concat(F.lit("topic-"), F.substring(F.md5(F.array_join(F.array_sort("terms"), "_")), 1, 8)).alias("topic_key"), F.col("component").alias("first_mention"), "label", "mentions", F.round(conf, 4).alias("confidence"))


def keyphrases(mentions: DataFrame, k: int = 5) -> DataFrame:
    """mention_id and keyphrases: three most frequent words of more than two characters, then three hashtags."""
    skip = ("the", "and", "with", "that", "this", "cho", "mấy", "bác", "url")
    each = mentions.select("mention_id", F.posexplode(F.filter(F.split("compact", " "), lambda t: (F.length(t) > 2) & ~t.isin(*skip))).alias("at", "token"))
    counted = each.groupBy("mention_id", "token").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = counted.groupBy("mention_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "token"))), 1, 3), lambda x: x["token"]).alias("best"))
    rows = mentions.select("mention_id", "hashtags").join(best, "mention_id", "left")
    every = F.concat(F.coalesce("best", F.array().cast("array<string>")), F.slice("hashtags", 1, 3))
    return rows.select("mention_id", F.slice(F.array_distinct(F.transform(every, lambda x: F.lower(F.trim(x)))), 1, k).alias("keyphrases"))


def emerging(current: DataFrame, previous: DataFrame) -> DataFrame:
    """token, mentions, growth_delta against the previous window's mentions of the same token; 0 there if absent."""
    was = previous.select(F.col("token").alias("_t"), F.col("mentions").alias("was"))
    rows = current.join(was, current["token"] == F.col("_t"), "left")
    return rows.select("token", "mentions", (F.col("mentions") - F.coalesce("was", F.lit(0))).alias("growth_delta"))
