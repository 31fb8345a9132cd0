"""Spam scores of mentions, quality of authors, and the weights that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.numbers import rounded_mean

SUSPICIOUS, REUSED = 0.65, 3


def scored(mentions: DataFrame) -> DataFrame:
    """Mentions (annotated by dedup) with mention_spam_score, reasons, suspicious, template_key, template_uses, repost."""
    parts = S.spam_parts(T.words(F.col("compact")), F.size("urls"), F.col("dedup_cluster_size"), T.is_repost(F.col("compact")))
    rows = mentions.select("*", *[p.alias(f"_{k}") for k, p in parts.items()])
    held = {k: F.col(f"_{k}") for k in parts}
    reasons = F.array_compact(F.array(*[F.when(c >= 0.5, k) for k, c in held.items()]))
    rows = rows.withColumns({"mention_spam_score": S.spam_score(held), "reasons": reasons, "repost": T.is_repost(F.col("compact")), "_template": F.xxhash64(T.template_key(F.col("normalized")))})
    rows = rows.withColumn("suspicious", F.col("mention_spam_score") >= SUSPICIOUS)
    # Counts per template come back by a join: they are summed before the shuffle, and a hot one can be split.
    uses = rows.groupBy("_template").agg(F.count("*").alias("template_uses"))
    return rows.join(uses, "_template").drop("_template", *[f"_{k}" for k in parts])


def authors(rows: DataFrame, bursts: DataFrame) -> DataFrame:
    """One row per author of scored mentions; bursts: author_id and burstiness.

    Scores have four digits: their mean is that of whole ten-thousandths, so no order of rows can change a digit of it.
    """
    n = F.count("*")
    total = F.sum(F.round(F.col("mention_spam_score") * 10_000).cast("long"))
    share = lambda cond: F.sum(F.when(cond, 1).otherwise(0)) / n
    found = rows.groupBy("author_id").agg(
        n.alias("mention_count"), F.sum(F.col("suspicious").cast("int")).alias("suspicious_mention_count"), (total / (n * 10_000)).alias("_avg"), rounded_mean(total, n).alias("_rounded"),
        share(F.col("dedup_cluster_size") > 1).alias("_dup"), share(F.col("template_uses") >= REUSED).alias("_template"), share(F.col("repost")).alias("_repost"))
    found = found.join(bursts.select("author_id", "burstiness"), "author_id", "left").withColumn("burstiness", F.coalesce("burstiness", F.lit(0.0)))
    base = F.round(F.least(F.col("_avg") * 0.42 + F.col("burstiness") * 0.18 + F.col("_dup") * 0.20 + F.col("_template") * 0.12 + F.col("_repost") * 0.08, F.lit(1.0)), 4)
    reasons = F.array_compact(F.array(
        F.when(F.col("burstiness") >= 0.55, "author_burstiness"), F.when(F.col("_dup") >= 0.45, "author_duplicate_participation"),
        F.when(F.col("_template") >= 0.45, "author_template_reuse"), F.when(F.col("_repost") >= 0.4, "author_repost_like_ratio"),
        F.when(F.col("_avg") >= 0.55, "high_average_mention_spam_score")))
    found = found.withColumn("reasons", reasons)
    score = F.round(F.least(base + F.least(F.size("reasons") * 0.03, F.lit(0.09)), F.lit(1.0)), 4)
    return found.select(
        "author_id", "mention_count", "suspicious_mention_count", score.alias("author_inorganic_score"), (score >= SUSPICIOUS).alias("author_suspicious"), "burstiness",
        F.round("_template", 4).alias("template_ratio"), F.round("_dup", 4).alias("duplicate_rate"), F.round("_repost", 4).alias("repost_ratio"), F.col("_rounded").alias("average_spam_score"), "reasons")


def weighted(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scored mentions with author scores, quality_weight, flags, label and route."""
    out = rows.join(profiles.select("author_id", "author_inorganic_score", "author_suspicious"), "author_id")
    return out.withColumn("quality_weight", S.quality_weight(F.col("dedup_weight"), F.col("mention_spam_score"), F.col("author_inorganic_score")))
