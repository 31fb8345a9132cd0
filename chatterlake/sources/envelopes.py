"""Ingest envelopes: two JSON formats, told apart by their keys, parsed into one record shape.

A message that is neither, or lacks what it must have, goes to the rejected rows with a
reason; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Versions of the nested format. Fixed value.
VERSIONS = ("1.0",)

NESTED = """struct<uap_version:string,event_id:string,
  ingest:struct<project_id:string,entity:struct<entity_type:string,entity_name:string,brand:string>,source:struct<source_id:string,source_type:string>,batch:struct<batch_id:string,mode:string,received_at:string>>,
  content:struct<doc_id:string,doc_type:string,text:string,url:string,language:string,published_at:string,author:struct<author_id:string,display_name:string,author_type:string,followers:string,is_verified:boolean>,
    parent:struct<parent_id:string,parent_type:string>,attachments:array<struct<type:string,url:string,content:string>>>,
  signals:struct<engagement:struct<like_count:string,comment_count:string,share_count:string,view_count:string,save_count:string,rating:string>,geo:struct<country:string,city:string>>,
  context:struct<keywords_matched:array<string>,campaign_id:string>>"""
FLAT = """struct<identity:struct<uap_id:string,uap_type:string,project_id:string,platform:string,origin_id:string,url:string,task_id:string>,hierarchy:struct<parent_id:string,root_id:string,depth:string>,
  content:struct<text:string,language:string>,author:struct<id:string,nickname:string,username:string,is_verified:boolean>,engagement:struct<likes:string,comments_count:string,shares:string,views:string,saves:string>,
  media:array<struct<type:string,url:string,download_url:string>>,temporal:struct<posted_at:string,ingested_at:string>,domain_type_code:string,crawl_keyword:string>"""


def count(text: Column) -> Column:
    """A whole number from text; what can't be read is 0. Fractions as text don't count, as numbers they are cut."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint")), F.lit(0).cast("bigint"))


def given(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def moment(text: Column) -> Column:
    """A time from ISO text, with Z or an offset; null if unreadable."""
    return F.try_to_timestamp(text)


def decoded(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages with `format`: nested, flat or null."""
    raw = F.col(value).cast("string")
    kind = F.when(F.get_json_object(raw, "$.uap_version").isNotNull(), "nested").when(F.get_json_object(raw, "$.identity").isNotNull(), "flat")
    return messages.withColumns({"_raw": raw, "format": kind})


def parsed(messages: DataFrame, value: str = "value") -> DataFrame:
    """One record a message: ids, texts, author, counts, times, attachments, and `reject_reason` (null for a good one)."""
    rows = decoded(messages, value).withColumns({"n": F.from_json("_raw", NESTED), "f": F.from_json("_raw", FLAT)})
    nested = F.col("format") == "nested"
    pick = lambda a, b: F.when(nested, F.col(a) if isinstance(a, str) else a).otherwise(F.col(b) if isinstance(b, str) else b)
    none = F.lit(None).cast("string")
    media = F.transform(F.col("f.media"), lambda m: F.struct(m["type"].alias("type"), F.coalesce(given(m["url"]), m["download_url"]).alias("url"), none.alias("content")))
    project, doc = pick("n.ingest.project_id", "f.identity.project_id"), pick("n.content.doc_id", "f.identity.uap_id")
    reason = (
        F.when(F.col("format").isNull(), "unknown_format")
        .when(nested & ~F.col("n.uap_version").isin(*VERSIONS), "unsupported_version")
        .when(nested & F.col("n.ingest").isNull(), "missing_ingest").when(nested & F.col("n.content").isNull(), "missing_content")
        .when(given(project).isNull(), "missing_project_id").when(given(doc).isNull(), "missing_doc_id"))
    kind = F.lower(F.coalesce(given(pick("n.content.doc_type", "f.identity.uap_type")), F.lit("post")))
    return rows.select(
        "format", reason.alias("reject_reason"), project.alias("project_id"), doc.alias("doc_id"), kind.alias("doc_type"), pick("n.content.text", "f.content.text").alias("text"),
        pick("n.content.language", "f.content.language").alias("language"), pick("n.content.url", "f.identity.url").alias("url"), F.lower(pick("n.ingest.source.source_type", "f.identity.platform")).alias("platform"),
        given(pick("n.content.parent.parent_id", "f.hierarchy.parent_id")).alias("parent_id"),
        F.coalesce(given(pick("n.content.author.author_id", "f.author.id")), given(pick("n.content.author.display_name", "f.author.nickname")), F.lit("unknown")).alias("author_id"),
        count(pick("n.content.author.followers", none)).alias("followers"), F.coalesce(pick("n.content.author.is_verified", "f.author.is_verified"), F.lit(False)).alias("is_verified"),
        *[count(pick(f"n.signals.engagement.{a}", f"f.engagement.{b}")).alias(c) for a, b, c in (
            ("like_count", "likes", "likes"), ("comment_count", "comments_count", "comments_count"), ("share_count", "shares", "shares"), ("view_count", "views", "views"), ("save_count", "saves", "saves"))],
        moment(pick("n.content.published_at", "f.temporal.posted_at")).alias("posted_at"), pick("n.content.attachments", media).alias("attachments"),
        pick(none, "f.domain_type_code").alias("domain_type_code"), pick("n.ingest.batch.batch_id", "f.identity.task_id").alias("batch_id"))


def accepted(records: DataFrame) -> DataFrame:
    return records.filter("reject_reason is null").drop("reject_reason")


def rejected(records: DataFrame) -> DataFrame:
    """Counts of rejected messages by reason."""
    return records.filter("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


#: Depth of each document type. Fixed values.
DEPTH = {"post": 0, "video": 0, "news": 0, "feedback": 0, "comment": 1, "reply": 2}
#: Namespace of mention ids.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def mentions(records: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Silver rows of accepted records: ids, hierarchy, normalized text, engagement (0 as null) and sort score."""
    depth = F.coalesce(*[F.when(F.col("doc_type") == k, v) for k, v in DEPTH.items()], F.lit(0))
    rows = records.withColumn("depth", depth)
    root = F.when(F.col("depth") == 0, F.col("doc_id")).otherwise(F.coalesce("parent_id", "doc_id"))
    score = F.col("likes") + 2 * F.col("shares") + 3 * F.col("comments_count") + F.floor(F.col("views") / 100)
    any_ = (F.greatest("likes", "shares", "comments_count", "views") > 0)
    raw = T.squeeze(F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"mention_id": T.uuid5(namespace, F.concat_ws(":", "project_id", "doc_id")), "origin_id": F.col("doc_id"), "root_id": root, "raw_text": raw, "sort_score": F.when(any_, score)})
    rows = rows.withColumns({"hashtags": T.hashtags(F.col("raw_text")), "urls": T.urls(F.col("raw_text")), "emojis": T.emojis(F.col("raw_text"))})
    rows = rows.withColumn("normalized", T.processing_text(F.col("raw_text"), F.col("hashtags"))).withColumn("compact", T.compact(F.col("normalized")))
    return rows.withColumns({c: F.nullif(F.col(c), F.lit(0).cast("bigint")) for c in ("likes", "comments_count", "shares", "views")})
