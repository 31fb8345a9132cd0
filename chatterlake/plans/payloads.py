"""What leaves the engine: messages, store rows, labels, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Labels and levels as consumers know them.
PLATFORMS = {"facebook": "FACEBOOK", "tiktok": "TIKTOK", "youtube": "YOUTUBE", "instagram": "INSTAGRAM", "multi": "MULTI"}
SENTIMENTS = {"POS": "POSITIVE", "NEG": "NEGATIVE", "NEU": "NEUTRAL", "POSITIVE": "POSITIVE", "NEGATIVE": "NEGATIVE", "NEUTRAL": "NEUTRAL"}
RISK = {"CRITICAL": 0.9, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.1}
MEDIA = {"video": "video", "image": "image", "photo": "image", "audio": "audio", "link": "link"}
#: What each report is about: grain, ranking, and what it is not for.
CONTRACTS = {
    "sov_report": ("entity", "share of mentions, then of hits", "reach or audience size"), "buzz_report": ("entity or topic", "weighted volume times growth", "reach"),
    "emerging_topics_report": ("topic", "change against the previous window", "forecasts"), "top_issues_report": ("issue category", "pressure", "verified incidents"),
    "thread_controversy_report": ("thread root", "controversy", "toxicity of a person"), "creator_source_breakdown_report": ("author or platform", "mentions", "audience size"),
}


def mapped(key: Column, table: dict, default: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], default)


def platform(name: Column) -> Column:
    return mapped(F.lower(name), PLATFORMS, F.lit("OTHER"))


def sentiment_label(label: Column) -> Column:
    return mapped(F.upper(label), SENTIMENTS, F.lit("NEUTRAL"))


def media_type(attachments: Column) -> Column:
    """The first attachment's kind; text if there is none."""
    return mapped(F.lower(F.get(attachments, 0)["type"]), MEDIA, F.lit("text"))


def signed(label: Column, score: Column) -> Column:
    """A negative label's score below zero."""
    return F.when((label == "NEGATIVE") & (score > 0), -score).otherwise(score)


def priority(impact: Column) -> Column:
    return F.when(impact >= 0.7, "HIGH").when(impact >= 0.4, "MEDIUM").otherwise("LOW")


def run_id(at: Column) -> Column:
    return F.concat(F.lit("run-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def window_label(starts: Column, ends: Column) -> Column:
    show = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat_ws(" to ", show(starts), show(ends))


def store_rows(results: DataFrame) -> DataFrame:
    """Results as the store keeps them. results: id, platform, intent, is_spam, risk_level, and what else there is."""
    return results.withColumns({
        "platform": F.lower("platform"), "risk_score": mapped(F.col("risk_level"), RISK, F.lit(0.1)),
        "is_spam": F.col("intent").isin("SPAM", "SEEDING") | F.coalesce("is_spam", F.lit(False)), "requires_attention": F.col("risk_level").isin("HIGH", "CRITICAL")})


def messages(results: DataFrame) -> DataFrame:
    """id and message: the nested insight message as JSON."""
    alert = F.col("risk_level").isin("HIGH", "CRITICAL")
    index = (F.length(F.coalesce("text", F.lit(""))) >= 10) & ~F.coalesce(F.col("intent").isin("SPAM", "SEEDING"), F.lit(False))
    body = F.struct(
        F.struct("project_id").alias("project"), F.struct("id", platform(F.col("platform")).alias("platform")).alias("identity"),
        F.struct(T.snippet(F.col("text")).alias("summary"), F.length("text").alias("chars")).alias("content"),
        F.struct("intent", sentiment_label(F.col("sentiment")).alias("sentiment")).alias("nlp"), F.struct("risk_level", alert.alias("alert")).alias("business"), F.struct(index.alias("should_index")).alias("rag"))
    return results.select("id", F.to_json(body).alias("message"))


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CONTRACTS.items()], "report_name string, grain string, ranking string, anti_use string")
