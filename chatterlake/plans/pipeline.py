"""The batch pipeline: messages to mentions to facts to reports, each stage a lazy function that flags can leave out.

Streams call the same function inside foreachBatch, with the batch as its input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import scores as S
from ..functions import text as T
from ..functions.numbers import confidence
from ..operators import dedup, entities, semantics, spam, threads, topics, windows
from ..operators.lineage import cut
from ..sources import envelopes
from . import reports as R

#: Stages in their order. Fixed values.
STAGES = ("normalization", "dedup", "spam", "threads", "nlp", "enrichment", "review", "reporting", "crisis")


@dataclass(frozen=True)
class Options:
    """What runs, and how. weighting: raw, dedup or quality; thread_key: the id that parents refer to."""

    off: frozenset[str] = frozenset()
    weighting: str = "raw"
    thread_key: str = "origin_id"
    namespace: str = envelopes.NAMESPACE

    def on(self, stage: str) -> bool:
        return stage not in self.off


def normalized(records: DataFrame, options: Options) -> DataFrame:
    """Silver mentions in a supported language, with quality labels and a route."""
    rows = envelopes.mentions(records, options.namespace)
    given = F.coalesce(envelopes.given(F.col("language")), F.lit(""))
    rows = rows.withColumn("_found", F.when(given != "", F.struct(L.canonical(given).alias("language"), F.lit(1.0).alias("confidence"))).otherwise(L.detected(F.col("raw_text"), L.candidates(F.col("raw_text")))))
    rows = rows.withColumn("_gate", L.gate(F.col("raw_text"), F.col("compact"), L.canonical(F.col("_found.language"))))
    supported = F.col("_gate.supported")
    rows = rows.withColumns({"language": F.col("_gate.language"), "language_confidence": F.round(F.greatest(F.col("_found.confidence"), F.when(supported, 0.72).otherwise(0.0)), 4), "language_supported": supported})
    flags = T.quality_flags(F.col("raw_text"), F.col("normalized"), F.col("compact"), F.col("urls"), F.col("emojis"), F.col("language_supported"))
    rows = rows.withColumn("text_quality_flags", flags).drop("_found", "_gate").filter("language_supported")
    return rows.withColumns({"text": F.col("raw_text"), "text_quality_label": T.quality_label(F.col("text_quality_flags")), "text_quality_score": T.quality_score(F.col("text_quality_flags"))})


def weighed(mentions: DataFrame, options: Options) -> DataFrame:
    """Mentions with duplicate clusters, spam scores, author scores and weights, as far as those stages are on."""
    none = mentions.limit(0).select("mention_id", F.lit("").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"))
    clusters = dedup.exact_members(mentions).select("mention_id", "cluster_id", "cluster_size") if options.on("dedup") else none
    rows = dedup.annotated(mentions, clusters)
    if not options.on("spam"):
        return rows.withColumns({"mention_spam_score": F.lit(0.0), "quality_weight": F.col("dedup_weight"), "author_inorganic_score": F.lit(0.0)})
    scored = spam.scored(rows)
    return spam.weighted(scored, spam.authors(scored, windows.burstiness(rows, "author_id", "posted_at")))


def facts(mentions: DataFrame, ontology: DataFrame | None) -> dict[str, DataFrame]:
    """Fact tables of mentions. ontology: entity_id, name, aliases, ord; without one every entity stays unresolved."""
    hits = mentions.select("mention_id", F.explode(entities.candidates(F.col("raw_text"))).alias("c")).select("mention_id", "c.surface", "c.kind")
    if ontology is None:
        ontology = mentions.sparkSession.createDataFrame([], "entity_id string, name string, aliases array<string>, ord int")
    index = entities.alias_index(ontology)
    tops = topics.top_tokens(mentions)
    issues = semantics.anchors(mentions, semantics.ISSUES, 0.76).withColumnRenamed("category", "issue_category")
    corroborated = semantics.corroboration(issues.select("mention_id", F.col("issue_category").alias("category")).join(mentions.select("mention_id", "root_id", "text"), "mention_id"))
    mode = semantics.evidence_mode(F.col("text"))
    issue_rows = issues.join(mentions.select("mention_id", "root_id", mode.alias("evidence_mode")), "mention_id").join(
        corroborated.withColumnRenamed("category", "issue_category"), ["root_id", "issue_category", "mention_id"])
    issue_rows = cut(issue_rows.select(
        "mention_id", "root_id", "issue_category", "evidence_mode", semantics.severity(F.col("evidence_mode"), F.col("corroborating")).alias("severity"), confidence(0.44 + 0.1 * F.col("hits")).alias("confidence"),
        F.lit(None).cast("double").alias("target_grounding_confidence"), F.lit(None).cast("double").alias("corroboration_confidence")))
    rules = mentions.select("mention_id", S.stance(F.col("raw_text"), F.col("normalized")).alias("s"), S.intent(F.col("raw_text"), F.col("normalized")).alias("i"))
    return {
        "fact_mentions": mentions, "fact_entity_mentions": entities.resolved(hits, index), "fact_topics": tops, "fact_keywords": topics.keyphrases(mentions), "fact_issue_signals": issue_rows,
        "fact_sentiment": cut(semantics.mention_sentiment(mentions)), "fact_stance": rules.select("mention_id", "s.*"), "fact_intent": rules.select("mention_id", "i.*"),
        "fact_aspects": semantics.anchors(mentions, semantics.ASPECTS, 0.70),
        "fact_source_influence": mentions.select("mention_id", "author_id", F.col("platform").alias("channel"), S.influence_tier(F.col("likes"), F.col("comments_count"), F.col("shares"), F.col("views")).alias("influence_tier")),
        "dim_projects": mentions.select("project_id", "platform").distinct(), "dim_entities": ontology, "dim_authors": mentions.groupBy("author_id").agg(F.max("author_inorganic_score").alias("author_inorganic_score")),
        "dim_time": mentions.select(F.to_date("posted_at").alias("date")).filter("date is not null").distinct().select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.weekofyear("date").alias("week"), (F.weekday("date") + 1).alias("weekday"))}


def reported(marts: dict[str, DataFrame], options: Options) -> dict[str, DataFrame]:
    """The reports over a bundle of marts."""
    rows = marts["fact_mentions"].withColumn("weight", R.weight_of(options.weighting))
    split = cut(windows.half_split(rows.select("mention_id", "posted_at", "weight"), "posted_at", "mention_id"))
    thread_rows = marts["fact_threads"]
    roots = rows.select("mention_id", "root_id")
    moods = marts["fact_sentiment"].join(roots, "mention_id").select("root_id", "sentiment")
    topic_facts = marts["fact_topics"].filter("rank <= 3").select("token", "mention_id").join(split.select("mention_id", "weight", "half"), "mention_id")
    out = {
        "sov_report": R.top_share_of_voice(marts["fact_entity_mentions"], split, options.weighting != "raw"), "buzz_report": R.top_buzz(topic_facts, "token"), "top_issues_report": R.top_issues(marts["fact_issue_signals"], split),
        "thread_controversy_report": threads.controversy(thread_rows, rows, moods, marts["fact_issue_signals"]).orderBy(F.desc("controversy_score_proxy"), F.desc("total_mentions"), "root_id").limit(R.TOP),
        "unresolved_entities_report": R.unresolved_reasons(marts["fact_entity_mentions"]), "initiator_report": R.breakdown(rows.filter("depth = 0"), "author_id"), "emerging_topics_report": R.buzz(topic_facts, "token").select("token", (F.col("current_count") - F.col("previous_count")).alias("growth_delta")).orderBy(F.desc("growth_delta"), "token").limit(R.TOP)}
    said, kinds = marts["fact_topics"].filter("rank <= 3").select("mention_id", F.col("token").alias("topic")), marts["fact_issue_signals"].select("mention_id", "issue_category")
    out["creator_report"] = R.detailed_breakdown(rows, "author_id", said, kinds, out["thread_controversy_report"])
    out["source_report"] = R.detailed_breakdown(rows, "platform", said, kinds)
    out["sov_report"] = R.with_names(out["sov_report"], marts["dim_entities"])
    for name in ("sov_report", "buzz_report", "top_issues_report", "thread_controversy_report", "emerging_topics_report", "creator_report"):
        out[name] = cut(out[name])
    out["insight_cards"] = R.insight_cards(*[out[f"{name}_report"] for name in ("sov", "buzz", "emerging_topics", "top_issues", "thread_controversy", "creator")])
    return out


def run_batch(messages: DataFrame, ontology: DataFrame | None = None, options: Options = Options(), extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """All tables and reports of a batch of messages (`value`: JSON), lazily, by name. extra: further fact tables from mentions.

    What many tables read (mentions, threads, issues, sentiments, report rows) is computed
    once, into the checkpoint folder; the plans above it stay small.
    """
    records = envelopes.parsed(messages)
    out = {"rejected": envelopes.rejected(records)}
    mentions = cut(weighed(cut(normalized(envelopes.accepted(records), options)), options))
    out |= facts(mentions, ontology) if options.on("enrichment") else {"fact_mentions": mentions}
    out |= {name: work(mentions) for name, work in (extra or {}).items()}
    if options.on("threads"):
        out["fact_threads"] = cut(threads.summaries(mentions, options.thread_key))
        out["fact_thread_edges"] = threads.edges(mentions, options.thread_key)
    if options.on("reporting") and options.on("enrichment") and options.on("threads"):
        out |= reported(out, options)
        if options.on("crisis"):
            out["crisis"] = R.crisis(out["top_issues_report"], out["thread_controversy_report"], out["sov_report"])
    return out

