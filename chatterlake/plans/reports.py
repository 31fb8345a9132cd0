"""Business reports over facts: each is one lazy plan with its evidence gathered on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.numbers import growth, ratio
from ..operators.windows import first_rows

TOP = 10


def weight_of(mode: str = "raw") -> Column:
    """The column that weighs a mention: raw counts each once."""
    return {"raw": F.lit(1.0), "dedup": F.col("dedup_weight"), "quality": F.col("quality_weight")}[mode]


def share_of_voice(hits: DataFrame, mentions: DataFrame, weighted: bool = False) -> DataFrame:
    """Per entity: mentions, hits, effective volume, shares and their change between the halves.

    hits: mention_id, entity_id; mentions: mention_id, weight, half.
    """
    weight = F.coalesce("weight", F.lit(1.0)) if weighted else F.lit(1.0)
    # One row per entity and mention first: distinct counts are then plain counts.
    pairs = hits.filter("entity_id is not null").groupBy("entity_id", "mention_id").agg(F.count("*").alias("h"))
    rows = pairs.join(mentions.select("mention_id", "weight", "half"), "mention_id", "left").withColumn("w", weight)
    now, was = F.col("half") == "current", F.col("half") == "previous"
    pick = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    found = rows.groupBy("entity_id").agg(
        F.count("*").alias("mention_count"), F.sum("h").alias("hit_count"), F.round(F.sum("w"), 4).alias("effective_mention_count"),
        F.count_if(now).alias("_n1"), F.count_if(was).alias("_n0"), pick(now, "w").alias("_w1"), pick(was, "w").alias("_w0"), pick(now, "h").alias("_h1"), pick(was, "h").alias("_h0"))
    found = found.join(first_rows(pairs, "entity_id", "mention_id", 5).withColumnRenamed("first", "evidence"), "entity_id")
    sums = found.select(F.struct(*[F.sum(c).alias(c) for c in ("hit_count", "effective_mention_count", "_w1", "_w0", "_h1", "_h0")]).alias("sums")).scalar()
    total = lambda c: F.col("_sums")[c]
    resolved = pairs.select(F.count_distinct("mention_id")).scalar()
    slice_ = mentions.select(F.count("*")).scalar()
    found = found.withColumns({"_resolved": resolved, "_slice": slice_, "_sums": sums})
    return found.select(
        "entity_id", "mention_count", "hit_count", "effective_mention_count", ratio(F.col("mention_count"), F.col("_slice")).alias("mention_share"),
        ratio(F.col("hit_count"), total("hit_count")).alias("hit_share"), ratio(F.col("mention_count"), F.col("_resolved")).alias("resolved_share"),
        ratio(F.col("effective_mention_count"), total("effective_mention_count")).alias("effective_share"),
        (F.col("_n1") - F.col("_n0")).alias("delta_mention_count"), F.round(ratio(F.col("_w1"), total("_w1")) - ratio(F.col("_w0"), total("_w0")), 4).alias("delta_mention_share"),
        F.round(ratio(F.col("_h1"), total("_h1")) - ratio(F.col("_h0"), total("_h0")), 4).alias("delta_hit_share"), "evidence")


def top_share_of_voice(hits: DataFrame, mentions: DataFrame, weighted: bool = False, k: int = TOP) -> DataFrame:
    share = "effective_share" if weighted else "mention_share"
    return share_of_voice(hits, mentions, weighted).orderBy(F.desc(share), F.desc("hit_share"), "entity_id").limit(k)


def buzz(facts: DataFrame, key: str) -> DataFrame:
    """Per key: mentions in each half, growth and buzz. facts: key, mention_id, weight, half."""
    pairs = facts.groupBy(key, "mention_id").agg(F.max("weight").alias("w"), F.max("half").alias("half"))
    now, was = F.col("half") == "current", F.col("half") == "previous"
    rows = pairs.groupBy(key).agg(F.count("*").alias("mention_count"), F.round(F.sum("w"), 4).alias("effective_mention_count"), F.count_if(now).alias("current_count"), F.count_if(was).alias("previous_count"))
    rows = rows.withColumn("growth", growth(F.col("current_count"), F.col("previous_count")))
    return rows.withColumn("buzz_score_proxy", F.round(F.col("effective_mention_count") * (1 + F.greatest("growth", F.lit(0.0))), 4))


def top_buzz(facts: DataFrame, key: str, k: int = TOP) -> DataFrame:
    return buzz(facts, key).orderBy(F.desc("buzz_score_proxy"), F.desc("effective_mention_count"), key).limit(k)


def mix(facts: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n and share of each value in its group; null values are left out."""
    counts = facts.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(group))))


def mix_text(facts: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """group and its mix as one text: value=share, in the order of values."""
    each = F.concat(F.col(value).cast("string"), F.lit("="), F.format_string("%.4f", F.col("share")))
    return mix(facts, group, value).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(each)), "|").alias(name))


def top_issues(facts: DataFrame, mentions: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """Per issue category: facts, mentions, pressure; with mentions (mention_id, half) also prevalence, growth between the halves, mixes and evidence.

    facts: issue_category, mention_id, severity, evidence_mode, confidence, target_grounding_confidence, corroboration_confidence.
    """
    facts = facts.filter("issue_category is not null")
    pressure = S.issue_pressure(F.col("severity"), F.col("evidence_mode"), F.col("confidence"), F.col("target_grounding_confidence"), F.col("corroboration_confidence"))
    # One row per category and mention first: distinct counts are then plain counts.
    pairs = facts.groupBy("issue_category", "mention_id").agg(F.count("*").alias("n"), F.sum(pressure).alias("p"))
    if mentions is None:
        rows = pairs.groupBy("issue_category").agg(F.sum("n").alias("issue_rows"), F.count("*").alias("mention_count"), F.round(F.sum("p"), 4).alias("issue_pressure_proxy"))
        return rows.orderBy(F.desc("issue_pressure_proxy"), F.desc("mention_count"), "issue_category").limit(k)
    halves = pairs.join(mentions.select("mention_id", "half"), "mention_id", "left")
    rows = halves.groupBy("issue_category").agg(
        F.sum("n").alias("issue_rows"), F.count("*").alias("mention_count"), F.round(F.sum("p"), 4).alias("issue_pressure_proxy"),
        (F.count_if(F.col("half") == "current") - F.count_if(F.col("half") == "previous")).alias("growth_delta_mentions"))
    whole = mentions.select(F.count("*")).scalar()
    rows = rows.withColumn("_all", whole).withColumn("mention_prevalence_ratio", ratio(F.col("mention_count"), F.col("_all"))).drop("_all")
    best = rows.orderBy(F.desc("issue_pressure_proxy"), F.desc("mention_count"), "issue_category").limit(k)
    for more in (mix_text(facts, "issue_category", "severity", "severity_mix"), mix_text(facts, "issue_category", "evidence_mode", "evidence_mode_mix"),
                 first_rows(pairs, "issue_category", "mention_id", 5).withColumnRenamed("first", "evidence")):
        best = best.join(more, "issue_category", "left")
    return best


def unresolved_reasons(hits: DataFrame) -> DataFrame:
    """reason and hits of the entity candidates that stayed unresolved, most frequent first."""
    rows = hits.filter("entity_id is null").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("hits"))
    return rows.orderBy(F.desc("hits"), "reason")


def with_names(report: DataFrame, dimension: DataFrame) -> DataFrame:
    """A report on entities with their names from the dimension (entity_id, name); without one the id stands for it."""
    names = dimension.groupBy("entity_id").agg(F.max("name").alias("_name"))
    return report.join(names, "entity_id", "left").withColumn("entity_name", F.coalesce("_name", F.col("entity_id").cast("string"))).drop("_name")


def top_values(facts: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    """group and its k most frequent values, ties by value."""
    counts = facts.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def breakdown(mentions: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """The k keys with the most mentions."""
    return mentions.groupBy(key).agg(F.count("*").alias("mention_count")).orderBy(F.desc("mention_count"), key).limit(k)


#: Controversy score from which a thread counts for its authors. Fixed value.
CONTROVERSIAL = 0.35


def detailed_breakdown(mentions: DataFrame, key: str, topic_facts: DataFrame, issue_facts: DataFrame, threads: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """The k keys with the most mentions: share, their three top topics and issues, first mentions; with threads also how many controversial ones they take part in.

    mentions: mention_id, root_id, key; topic_facts: mention_id, topic; issue_facts: mention_id, issue_category; threads: root_id, controversy_score_proxy.
    """
    whole = mentions.select(F.count("*")).scalar()
    best = breakdown(mentions, key, k).withColumn("_all", whole).withColumn("conversation_share", ratio(F.col("mention_count"), F.col("_all"))).drop("_all")
    # At most k keys: a side that small is broadcast, and only their mentions go on.
    theirs = mentions.join(F.broadcast(best.select(key)), key, "left_semi")
    for facts, value, name in ((topic_facts, "topic", "top_topic_keys"), (issue_facts, "issue_category", "top_issue_categories")):
        ranked = top_values(theirs.select("mention_id", key).join(facts.select("mention_id", value), "mention_id"), key, value)
        listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(value).cast("string").alias("v")))).alias("l"))
        best = best.join(listed.select(key, F.array_join(F.transform("l", lambda x: x["v"]), ",").alias(name)), key, "left").fillna({name: ""})
    if threads is not None:
        hot = threads.filter(F.col("controversy_score_proxy") >= CONTROVERSIAL).select("root_id").distinct()
        mine = theirs.select(key, "root_id").distinct().join(hot, "root_id", "left_semi").groupBy(key).agg(F.count("*").alias("controversy_thread_count"))
        best = best.join(mine, key, "left").fillna({"controversy_thread_count": 0})
    return best.join(first_rows(theirs, key, "mention_id", 5).withColumnRenamed("first", "evidence"), key, "left")


def reportable(rows: DataFrame, status: str = "reporting_status", wanted: str = "reportable") -> DataFrame:
    """Rows of the wanted status; all rows if none has it."""
    any_ = rows.select(F.coalesce(F.bool_or(F.col(status) == wanted), F.lit(False))).scalar()
    return rows.withColumn("_any", any_).filter((F.col(status) == wanted) | ~F.col("_any")).drop("_any")


#: Thresholds of the crisis signals (watch, warning, critical) and the weights of the levels. Fixed values.
CRISIS = {"issue_pressure": (5.0, 12.0, 25.0), "thread_controversy": (0.45, 0.65, 0.80), "negative_entities": (0.40, 0.60, 0.75)}
LEVEL_WEIGHT = {"normal": 0.3, "watch": 1.0, "warning": 1.8, "critical": 2.5}


def signal_level(kind: str, value: Column) -> Column:
    watch, warning, critical = CRISIS[kind]
    return F.when(value >= critical, "critical").when(value >= warning, "warning").when(value >= watch, "watch").otherwise("none")


def crisis(issues: DataFrame, threads: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: the signals' values and levels, their weight and the overall level, from the top rows of three reports."""
    pressure = issues.agg(F.coalesce(F.max("issue_pressure_proxy"), F.lit(0.0)).alias("v")).scalar()
    heat = threads.agg(F.coalesce(F.max("controversy_score_proxy"), F.lit(0.0)).alias("v")).scalar()
    falling = entities.agg(ratio(F.count_if(F.col("delta_mention_count") < 0), F.count("*")).alias("v")).scalar()
    row = entities.sparkSession.range(1).select(pressure.alias("issue_pressure"), heat.alias("thread_controversy"), falling.alias("negative_entities"))
    row = row.withColumns({f"{k}_level": signal_level(k, F.col(k)) for k in CRISIS})
    levels = [F.col(f"{k}_level") for k in CRISIS]
    weight = sum((F.when(x != "none", S.looked_up(x, LEVEL_WEIGHT, 0.0)).otherwise(0.0) for x in levels), F.lit(0.0))
    row = row.withColumn("weight", F.round(weight, 4))
    worst = levels[0].isin("critical") | levels[1].isin("critical") | levels[2].isin("critical")
    return row.withColumn("crisis_level", F.when(worst | (F.col("weight") >= 5), "critical").when(F.col("weight") >= 2.5, "warning").when(F.col("weight") >= 0.8, "watch").otherwise("normal"))


def insight_cards(sov: DataFrame, topics: DataFrame, emerging: DataFrame, issues: DataFrame, threads: DataFrame, creators: DataFrame) -> DataFrame:
    """Up to seven cards, each for the first row of a report that has one: insight_type, title, summary, metric, confidence, evidence, filter_key, filter_value, source_reports.

    sov: entity_id, entity_name if there; topics and emerging: their first column is the key; reportability_score and quality_score
    count where a report has them. creators: their first column is the key, mention_count and conversation_share.
    """
    def value(rows: DataFrame, name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in rows.columns else F.lit(0.0)

    def evidence(rows: DataFrame) -> Column:
        return F.array_join(F.col("evidence").cast("array<string>"), ",") if "evidence" in rows.columns else F.lit("")

    def card(rows: DataFrame, kind: str, title: Column, summary: Column, metric: Column, confidence: Column, most: float, key: str, reports: str) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("insight_type"), title.alias("title"), summary.alias("summary"), metric.cast("double").alias("metric"), F.round(F.least(confidence, F.lit(most)), 6).alias("confidence"),
            evidence(rows).alias("evidence"), F.lit(key).alias("filter_key"), F.col(key).cast("string").alias("filter_value"), F.lit(reports).alias("source_reports"))

    text = lambda c: F.col(c).cast("string")
    top = sov.orderBy(F.desc("mention_share"), F.desc("hit_share"), "entity_id").limit(1).filter("delta_mention_count != 0")
    name = F.coalesce(F.col("entity_name"), text("entity_id")) if "entity_name" in sov.columns else text("entity_id")
    change = F.col("delta_mention_count")
    cards = card(
        top, "share_of_voice_shift", F.concat(F.lit("Share of voice shift detected for "), name),
        F.concat(name, F.when(change > 0, " gained ").otherwise(" lost "), F.abs(change).cast("string"), F.lit(" mention(s) in the later half of the window.")),
        F.col("delta_mention_share"), 0.55 + F.abs("delta_mention_share"), 0.9, "entity_id", "sov_report,buzz_report")
    key = topics.columns[0]
    loud = topics.orderBy(F.desc("buzz_score_proxy"), F.desc("effective_mention_count"), key).limit(1)
    grown, fit = F.greatest("growth", F.lit(0.0)), value(topics, "reportability_score")
    counts = F.concat(text("mention_count"), F.lit(" raw mentions and "), F.format_string("%.2f", "effective_mention_count"), F.lit(" effective mentions."))
    cards = cards.union(card(
        loud, "trending_topic", F.concat(F.lit("Topic gaining volume: "), text(key)), F.concat(text(key), F.lit(" is reportable in "), counts), F.col("buzz_score_proxy"), 0.5 + grown * 0.1 + fit * 0.18, 0.86, key, "buzz_report"))
    cards = cards.union(card(
        loud, "conversation_hotspot", F.concat(F.lit("Topic buzz concentrating around "), text(key)), F.concat(text(key), F.lit(" appears in "), text("mention_count"), F.lit(" mentions.")),
        F.col("buzz_score_proxy"), 0.52 + grown * 0.12 + fit * 0.16, 0.88, key, "buzz_report"))
    rising = emerging.columns[0]
    new = emerging.orderBy(F.desc("growth_delta"), rising).limit(1)
    cards = cards.union(card(
        new, "emerging_topic", F.concat(F.lit("Emerging topic: "), text(rising)), F.concat(text(rising), F.lit(" passed quality gates with growth delta "), F.format_string("%.1f", F.col("growth_delta").cast("double")), F.lit(".")),
        F.col("growth_delta"), 0.54 + value(emerging, "quality_score") * 0.14 + value(emerging, "reportability_score") * 0.18, 0.92, rising, "emerging_topics_report"))
    issue = issues.orderBy(F.desc("issue_pressure_proxy"), F.desc("mention_count"), "issue_category").limit(1)
    pressure = F.col("issue_pressure_proxy")
    cards = cards.union(card(
        issue, "issue_warning", F.concat(F.lit("Issue pressure around "), text("issue_category")), F.concat(text("issue_category"), F.lit(" leads the issue report across "), text("mention_count"), F.lit(" mentions.")),
        pressure, 0.58 + pressure / F.greatest(pressure, F.lit(1.0)) * 0.18, 0.86, "issue_category", "top_issues_report"))
    thread = threads.orderBy(F.desc("controversy_score_proxy"), F.desc("total_mentions"), "root_id").limit(1)
    cards = cards.union(card(
        thread, "controversy_alert", F.concat(F.lit("Controversy proxy elevated for thread "), text("root_id")), F.concat(F.lit("Thread "), text("root_id"), F.lit(" stands out by reply density, recursion, polarity conflict, and diversity signals.")),
        F.col("controversy_score_proxy"), 0.52 + F.col("controversy_score_proxy") * 0.25, 0.84, "root_id", "thread_controversy_report"))
    author = creators.columns[0]
    first = creators.orderBy(F.desc("mention_count"), author).limit(1)
    return cards.union(card(
        first, "creator_concentration", F.concat(F.lit("Creator concentration around "), text(author)), F.concat(text(author), F.lit(" contributed "), text("mention_count"), F.lit(" mentions, or "), F.format_string("%.2f", 100 * F.col("conversation_share")), F.lit("% of the slice.")),
        F.col("conversation_share"), 0.5 + F.col("conversation_share") * 0.5, 0.8, author, "creator_source_breakdown_report"))
