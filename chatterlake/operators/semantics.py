"""Segments, lexical anchors with negation, sentiment, aspects, issues and corroboration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import confidence

# Cue words. Configuration: small samples.
POSITIVE = {"good": 0.6, "great": 0.8, "love": 0.9, "best": 0.8, "tốt": 0.7, "đẹp": 0.7}
NEGATIVE = {"bad": -0.6, "worthless": -0.8, "trash": -0.8, "disgusting": -0.9, "pathetic": -0.8, "stupid": -0.7, "idiot": -0.8, "scum": -0.9, "moron": -0.8, "loser": -0.7, "clown": -0.5, "lỗi": -0.6, "chậm": -0.5}
NEGATIONS = ("not", "no", "never", "không", "chưa")
ASPECTS = {"price": ("price", "cost", "value", "giá"), "quality": ("quality", "build", "chất"), "trust": ("trust", "fake", "scam", "legit"), "delivery": ("delivery", "ship", "delay", "giao")}
ISSUES = {"insult": ("idiot", "moron", "loser", "clown", "stupid"), "disgust": ("scum", "trash", "disgusting", "pathetic", "worthless")}
#: A cue is turned round by a negation that starts at most so many characters before it.
REACH = 14


def segments(text: Column) -> Column:
    """Clauses: the text between hard boundaries and contrast words, each with its place."""
    bare = F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{N}_])(but|however|nhưng|tuy nhiên)(?![\p{L}\p{N}_])", "\n")
    parts = F.transform(F.split(bare, r"[,.!?;\n|*]+"), lambda x: F.trim(x))
    return F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("nth"), x.alias("text"))), lambda s: s["text"] != "")


def polarity(text: Column) -> Column:
    """Sum of cue weights in a text; a negation shortly before a cue turns it round."""
    text = F.lower(text)
    total = F.lit(0.0)
    near = "|".join(NEGATIONS)
    for cue, weight in {**POSITIVE, **NEGATIVE}.items():
        alone = rf"(?<![\p{{L}}\p{{N}}_]){cue}(?![\p{{L}}\p{{N}}_])"
        turned = F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{near})(?![\p{{L}}\p{{N}}_])(?=.{{0,{REACH}}}{alone})"))
        found = F.regexp_count(text, F.lit(alone))
        total = total + weight * (found - 2 * F.least(turned, found))
    return total


def label(score: Column) -> Column:
    return F.when(score >= 0.35, "positive").when(score <= -0.35, "negative").when(F.abs(score) < 0.15, "neutral").otherwise("mixed")


def merged(labels: Column) -> Column:
    """One label of several: mixed where both poles occur."""
    has = lambda x: F.array_contains(labels, x)
    return F.when(has("positive") & has("negative"), "mixed").when(has("negative"), "negative").when(has("positive"), "positive").when(has("mixed"), "mixed").otherwise("neutral")


def mention_sentiment(mentions: DataFrame) -> DataFrame:
    """mention_id, sentiment, score, confidence, segments with a cue."""
    each = mentions.select("mention_id", F.explode(segments(F.col("text"))).alias("s")).select("mention_id", polarity(F.col("s.text")).alias("p"))
    cued = each.groupBy("mention_id").agg(F.collect_set(label(F.col("p"))).alias("labels"), F.round(F.abs(F.sum("p")), 3).alias("score"), F.count_if(F.col("p") != 0).alias("cued_segments"))
    return cued.select("mention_id", merged(F.col("labels")).alias("sentiment"), "score", confidence(0.5 + F.least(F.col("cued_segments") * 0.08, F.lit(0.32))).alias("confidence"), "cued_segments")


def hits(tokens: Column, listed: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*listed)))


def anchors(mentions: DataFrame, seeds: dict[str, tuple[str, ...]], strength: float) -> DataFrame:
    """mention_id, category, hits, confidence of every seed category found in a text's words."""
    tokens = T.words(F.lower(F.col("text")))
    counts = F.array(*[F.struct(F.lit(k).alias("category"), hits(tokens, w).alias("hits")) for k, w in seeds.items()])
    found = mentions.select("mention_id", F.explode(F.filter(counts, lambda x: x["hits"] > 0)).alias("x"))
    return found.select("mention_id", F.col("x.category").alias("category"), F.col("x.hits").alias("hits"), F.lit(strength).alias("confidence"))


def evidence_mode(text: Column) -> Column:
    """What kind of evidence a text is; the later rule wins."""
    lowered = F.lower(text)
    any_word = lambda *w: reduce(lambda a, x: a | lowered.contains(x), w, F.lit(False))
    return (
        F.when(lowered.contains("?") | any_word("maybe", "perhaps"), "question_or_uncertainty").when(any_word("heard", "rumor", "nghe nói"), "hearsay_or_rumor")
        .when(any_word("boycott", "lawsuit", "tẩy chay"), "escalation_signal").when(any_word("worthless", "disgusting", "lỗi"), "direct_complaint").otherwise("direct_observation")
    )


def corroboration(facts: DataFrame, least: float = 0.52, most: int = 96) -> DataFrame:
    """facts (root_id, category, mention_id, text) with corroborating: similar peers in the same root and category, itself included.

    A group of more than `most` facts counts equal texts instead of comparing pairs.
    """
    keys = ["root_id", "category"]
    sets = facts.select(*keys, "mention_id", F.xxhash64("text").alias("h"), F.array_distinct(T.words(F.lower(F.col("text")))).alias("w"))
    sizes = sets.groupBy(*keys).agg(F.count("*").alias("g"))
    rows = sets.join(sizes, keys)
    same = rows.filter(F.col("g") > most).groupBy(*keys, "h").agg(F.count("*").alias("corroborating"))
    large = rows.filter(F.col("g") > most).join(same, [*keys, "h"]).select(*keys, "mention_id", "corroborating")
    few = rows.filter(F.col("g") <= most)
    left, right = (few.select(*keys, F.col("mention_id").alias(k), F.col("w").alias(f"w_{k}")) for k in "ab")
    alike = left.join(right, keys).filter((F.col("a") == F.col("b")) | (T.shared_share(F.col("w_a"), F.col("w_b")) >= least))
    return alike.groupBy(*keys, F.col("a").alias("mention_id")).agg(F.count("*").alias("corroborating")).union(large)


def severity(mode: Column, corroborating: Column) -> Column:
    """Severity of an issue fact from how it is known and how many say so."""
    base = F.when(corroborating >= 3, "high").when(corroborating > 1, "medium").otherwise("low")
    return F.when(mode.isin("question_or_uncertainty", "hearsay_or_rumor"), "low").otherwise(base)
