"""Report queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads, windows
from . import adapters as A
from . import reports as R
from .registry import listing

QUERIES, ORACLE_SQL, query = listing()

HALVES = """
  dated AS (SELECT o_orderkey AS mention_id, o_orderdate AS posted_at, CASE WHEN o_orderpriority LIKE '1%' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM orders),
  halves AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY posted_at, mention_id) <= (SELECT count(*) FROM dated) // 2 THEN 'previous' ELSE 'current' END AS half FROM dated),
  hits AS (SELECT l_orderkey AS mention_id, p_brand AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey),
  pairs AS (SELECT entity_id, mention_id, count(*) AS h FROM hits GROUP BY ALL)"""


def sov_sql(weight: str) -> str:
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / CAST({b} AS DOUBLE), 4) ELSE 0.0::DOUBLE END"
    return f"""WITH {HALVES},
  found AS (SELECT entity_id, count(*) AS mention_count, sum(h) AS hit_count, round(sum({weight}), 4) AS effective_mention_count,
    count(*) FILTER (half = 'current') AS n1, count(*) FILTER (half = 'previous') AS n0, sum(CASE WHEN half = 'current' THEN {weight} ELSE 0 END) AS w1, sum(CASE WHEN half = 'previous' THEN {weight} ELSE 0 END) AS w0,
    sum(CASE WHEN half = 'current' THEN h ELSE 0 END) AS h1, sum(CASE WHEN half = 'previous' THEN h ELSE 0 END) AS h0, list_slice(list_sort(list(p.mention_id)), 1, 5) AS evidence
    FROM pairs p LEFT JOIN halves USING (mention_id) GROUP BY entity_id)
  SELECT entity_id, mention_count, CAST(hit_count AS BIGINT) AS hit_count, effective_mention_count, {r('mention_count', '(SELECT count(*) FROM dated)')} AS mention_share,
    {r('hit_count', 'sum(hit_count) OVER ()')} AS hit_share, {r('mention_count', '(SELECT count(DISTINCT mention_id) FROM pairs)')} AS resolved_share,
    {r('effective_mention_count', 'sum(effective_mention_count) OVER ()')} AS effective_share, n1 - n0 AS delta_mention_count,
    round(({r('w1', 'sum(w1) OVER ()')}) - ({r('w0', 'sum(w0) OVER ()')}), 4) AS delta_mention_share,
    round(({r('h1', 'sum(h1) OVER ()')}) - ({r('h0', 'sum(h0) OVER ()')}), 4) AS delta_hit_share, evidence FROM found"""


def sov_inputs(spark, sf_dir):
    return A.brand_hits(spark, sf_dir), windows.half_split(A.orders(spark, sf_dir), "posted_at", "mention_id")


@query(f"SELECT * FROM ({sov_sql('1.0::DOUBLE')}) ORDER BY mention_share DESC, hit_share DESC, entity_id LIMIT 10")
def sov_brand(spark, sf_dir):
    return R.top_share_of_voice(*sov_inputs(spark, sf_dir))


@query(f"SELECT * FROM ({sov_sql('weight')}) ORDER BY effective_share DESC, hit_share DESC, entity_id LIMIT 10")
def sov_brand_weighted(spark, sf_dir):
    return R.top_share_of_voice(*sov_inputs(spark, sf_dir), weighted=True)


EVENT_HALVES = """
  ranked AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= (SELECT count(*) FROM events) // 2 AS early FROM events)"""


@query(f"WITH {EVENT_HALVES} SELECT CASE WHEN early THEN 'previous' ELSE 'current' END AS half, min(ts) AS starts, max(ts) AS ends, count(*) AS mentions FROM ranked GROUP BY early")
def half_split_window(spark, sf_dir):
    return windows.half_bounds(windows.half_split(A.timed(spark, sf_dir), "posted_at", "mention_id"), "posted_at")


BUZZ = f"""WITH {EVENT_HALVES},
  c AS (SELECT event_type AS topic, count(*) AS mention_count, CAST(count(*) AS DOUBLE) AS effective_mention_count, count(*) FILTER (NOT early) AS current_count, count(*) FILTER (early) AS previous_count FROM ranked GROUP BY 1),
  g AS (SELECT *, round(CASE WHEN previous_count <= 0 THEN CASE WHEN current_count <= 0 THEN 0.0 ELSE CAST(current_count AS DOUBLE) END ELSE (current_count - previous_count) / CAST(previous_count AS DOUBLE) END, 4) AS growth FROM c)
  SELECT *, round(effective_mention_count * (1 + greatest(growth, 0.0)), 4) AS buzz_score_proxy FROM g"""


def event_topics(spark, sf_dir):
    rows = A.timed(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return windows.half_split(rows, "posted_at", "mention_id").select("topic", "mention_id", "weight", "half")


@query(f"SELECT * FROM ({BUZZ}) ORDER BY buzz_score_proxy DESC, effective_mention_count DESC, topic LIMIT 10")
def buzz_event_type(spark, sf_dir):
    return R.top_buzz(event_topics(spark, sf_dir), "topic")


@query(f"SELECT topic, current_count - previous_count AS delta_count, growth FROM ({BUZZ})")
def growth_delta(spark, sf_dir):
    return R.buzz(event_topics(spark, sf_dir), "topic").select("topic", (F.col("current_count") - F.col("previous_count")).alias("delta_count"), "growth")


def issue_facts(spark, sf_dir):
    """events as issue facts: severity and evidence from the value."""
    v = F.col("value")
    return A.timed(spark, sf_dir).select(
        F.col("topic").alias("issue_category"), "mention_id", F.when(v >= 40, "critical_like_proxy").when(v >= 20, "high").when(v >= 8, "medium").otherwise("low").alias("severity"),
        F.when(F.col("mention_id") % 3 == 0, "direct_complaint").when(F.col("mention_id") % 3 == 1, "hearsay_or_rumor").otherwise("unlisted").alias("evidence_mode"),
        F.least(v / 50, F.lit(1.0)).alias("confidence"), F.lit(None).cast("double").alias("target_grounding_confidence"), F.when(F.col("mention_id") % 2 == 0, 0.9).alias("corroboration_confidence"))


ISSUES = """facts AS (SELECT event_type AS issue_category, event_id AS mention_id,
    CASE WHEN value >= 40 THEN 'critical_like_proxy' WHEN value >= 20 THEN 'high' WHEN value >= 8 THEN 'medium' ELSE 'low' END AS severity,
    CASE event_id % 3 WHEN 0 THEN 'direct_complaint' WHEN 1 THEN 'hearsay_or_rumor' ELSE 'unlisted' END AS evidence_mode, least(value / 50, 1.0::DOUBLE) AS confidence, CASE WHEN event_id % 2 = 0 THEN 0.9::DOUBLE END AS corroboration FROM events)"""
TOP_ISSUES = f"""WITH {ISSUES} SELECT issue_category, count(*) AS issue_rows, count(DISTINCT mention_id) AS mention_count,
    round(sum(CASE severity WHEN 'low' THEN 0.6 WHEN 'medium' THEN 1.0 WHEN 'high' THEN 1.45 ELSE 1.8 END::DOUBLE * CASE evidence_mode WHEN 'direct_complaint' THEN 1.0 WHEN 'hearsay_or_rumor' THEN 0.45 ELSE 0.7 END::DOUBLE
      * (0.35::DOUBLE + 0.65::DOUBLE * ((greatest(confidence, 0.25) + 0.55 + greatest(coalesce(corroboration, 0.5), 0.35)) / 3))), 4) AS issue_pressure_proxy
    FROM facts GROUP BY 1 ORDER BY issue_pressure_proxy DESC, mention_count DESC, issue_category LIMIT 10"""


def mix_sql(value: str) -> str:
    return f"""SELECT issue_category, string_agg({value} || '=' || printf('%.4f', share), '|' ORDER BY {value}) AS mix FROM
    (SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY issue_category) AS DOUBLE), 4) AS share FROM (SELECT issue_category, {value}, count(*) AS n FROM facts GROUP BY ALL)) GROUP BY 1"""


DETAILED_ISSUES = f"""WITH {ISSUES}, {EVENT_HALVES}, best AS ({TOP_ISSUES.replace("WITH " + ISSUES, "")}),
  g AS (SELECT issue_category, count(*) FILTER (NOT early) - count(*) FILTER (early) AS growth_delta_mentions, list_slice(list_sort(list(mention_id)), 1, 5) AS evidence FROM facts JOIN ranked ON event_id = mention_id GROUP BY 1)
  SELECT best.*, growth_delta_mentions, round(mention_count / CAST((SELECT count(*) FROM events) AS DOUBLE), 4) AS mention_prevalence_ratio, s.mix AS severity_mix, e.mix AS evidence_mode_mix, evidence
  FROM best JOIN g USING (issue_category) JOIN ({mix_sql("severity")}) s USING (issue_category) JOIN ({mix_sql("evidence_mode")}) e USING (issue_category)"""


@query(DETAILED_ISSUES)
def top_issues(spark, sf_dir):
    return R.top_issues(issue_facts(spark, sf_dir), windows.half_split(A.timed(spark, sf_dir), "posted_at", "mention_id"))


@query(f"WITH {ISSUES}, c AS (SELECT issue_category, severity, count(*) AS n FROM facts GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY issue_category) AS DOUBLE), 4) AS share FROM c")
def issue_mix(spark, sf_dir):
    return R.mix(issue_facts(spark, sf_dir), "issue_category", "severity")


@query(f"WITH {ISSUES}, c AS (SELECT severity, issue_category, count(*) AS n FROM facts GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, issue_category)::INTEGER AS rank FROM c QUALIFY rank <= 3")
def top_values(spark, sf_dir):
    return R.top_values(issue_facts(spark, sf_dir), "severity", "issue_category")


def creators(spark, sf_dir):
    """events as mentions of threads (97 of them, a fifth controversial), their types as topics and severities as issues."""
    rows = A.timed(spark, sf_dir).withColumn("root_id", F.col("mention_id") % 97)
    kinds = issue_facts(spark, sf_dir).select("mention_id", F.col("severity").alias("issue_category"))
    threads = rows.select("root_id", F.when(F.col("root_id") % 5 == 0, 0.5).otherwise(0.1).alias("controversy_score_proxy")).distinct()
    return R.detailed_breakdown(rows, "author_id", rows.select("mention_id", "topic"), kinds, threads)


def listed_sql(value: str) -> str:
    return f"""(SELECT author_id, string_agg({value}, ',' ORDER BY n DESC, {value}) AS l FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, {value}) AS k
    FROM (SELECT user_id AS author_id, {value}, count(*) AS n FROM events JOIN facts ON event_id = mention_id GROUP BY ALL)) WHERE k <= 3 GROUP BY 1)"""


CREATORS = f"""WITH {ISSUES}, best AS (SELECT user_id AS author_id, count(*) AS mention_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
  SELECT best.*, round(mention_count / CAST((SELECT count(*) FROM events) AS DOUBLE), 4) AS conversation_share, t.l AS top_topic_keys, i.l AS top_issue_categories,
    (SELECT count(DISTINCT event_id % 97) FILTER (event_id % 97 % 5 = 0) FROM events WHERE user_id = best.author_id) AS controversy_thread_count,
    (SELECT list_slice(list_sort(list(event_id)), 1, 5) FROM events WHERE user_id = best.author_id) AS evidence
  FROM best JOIN {listed_sql("event_type")} t USING (author_id) JOIN {listed_sql("severity")} i USING (author_id)"""


@query(CREATORS)
def creator_breakdown(spark, sf_dir):
    return creators(spark, sf_dir)


@query("SELECT role AS author_id, count(*) AS mention_count FROM conversations WHERE turn = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def initiators(spark, sf_dir):
    return R.breakdown(A.thread_mentions(spark, sf_dir).filter("depth = 0"), "author_id")


@query("SELECT source AS platform, count(*) AS mention_count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def source_breakdown(spark, sf_dir):
    return R.breakdown(A.table(spark, sf_dir, "documents").select(F.col("source").alias("platform")), "platform")


def thread_parts(spark, sf_dir):
    """Threads with stand-in sentiments and issues from single words."""
    rows = A.thread_mentions(spark, sf_dir)
    moods = rows.select("root_id", F.when(F.lower("text").contains("ing"), "positive").when(F.lower("text").contains("en"), "negative").otherwise("neutral").alias("sentiment"))
    issues = rows.filter(F.length("text") > 200).select("root_id", F.concat(F.lit("size"), F.length("text") % 4).alias("issue_category"))
    return rows, moods, issues


CONTROVERSY = """WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS root_id, least(turn, 2) AS depth, role, text FROM conversations),
  s AS (SELECT root_id, count(*) AS total, max(depth) AS deepest, count(*) FILTER (depth = 1) AS comments, count(*) FILTER (depth >= 2) AS replies, count(DISTINCT role) AS authors,
    count(*) FILTER (lower(text) LIKE '%ing%') AS p, count(*) FILTER (lower(text) NOT LIKE '%ing%' AND lower(text) LIKE '%en%') AS n,
    count(DISTINCT CASE WHEN length(text) > 200 THEN length(text) % 4 END) AS kinds, count(*) FILTER (length(text) > 200) AS issues FROM m GROUP BY 1),
  x AS (SELECT root_id, total AS total_mentions, round(replies / CAST(greatest(comments, 1) AS DOUBLE), 4) AS reply_density_proxy, round(deepest / CAST(greatest(total, 1) AS DOUBLE), 4) AS recursion_proxy,
    least(p, n) / CAST(greatest(p + n, 1) AS DOUBLE) AS mixed, round(authors / CAST(total AS DOUBLE), 4) AS author_diversity_proxy, round(kinds / CAST(greatest(issues, 1) AS DOUBLE), 4) AS issue_diversity_proxy FROM s)
  SELECT root_id, total_mentions, reply_density_proxy, recursion_proxy, author_diversity_proxy, issue_diversity_proxy,
    round(least(reply_density_proxy * 0.28::DOUBLE + recursion_proxy * 0.24::DOUBLE + mixed * 0.24::DOUBLE + author_diversity_proxy * 0.14::DOUBLE + issue_diversity_proxy * 0.10::DOUBLE, 1.0::DOUBLE), 4) AS controversy_score_proxy, round(mixed, 4) AS mixed_sentiment_proxy FROM x"""
TOP_CONTROVERSY = f"SELECT * FROM ({CONTROVERSY}) ORDER BY controversy_score_proxy DESC, total_mentions DESC, root_id LIMIT 10"


@query(TOP_CONTROVERSY)
def thread_controversy(spark, sf_dir):
    rows, moods, issues = thread_parts(spark, sf_dir)
    return threads.controversy(threads.summaries(rows), rows, moods, issues).orderBy(F.desc("controversy_score_proxy"), F.desc("total_mentions"), "root_id").limit(10)


@query(f"""WITH v AS (SELECT (SELECT max(issue_pressure_proxy) FROM ({TOP_ISSUES})) AS issue_pressure, (SELECT max(controversy_score_proxy) FROM ({TOP_CONTROVERSY})) AS thread_controversy,
    (SELECT round(count(*) FILTER (delta_mention_count < 0) / CAST(count(*) AS DOUBLE), 4) FROM ({ORACLE_SQL['sov_brand']})) AS negative_entities),
  l AS (SELECT *, CASE WHEN issue_pressure >= 25 THEN 'critical' WHEN issue_pressure >= 12 THEN 'warning' WHEN issue_pressure >= 5 THEN 'watch' ELSE 'none' END AS issue_pressure_level,
    CASE WHEN thread_controversy >= 0.80 THEN 'critical' WHEN thread_controversy >= 0.65 THEN 'warning' WHEN thread_controversy >= 0.45 THEN 'watch' ELSE 'none' END AS thread_controversy_level,
    CASE WHEN negative_entities >= 0.75 THEN 'critical' WHEN negative_entities >= 0.60 THEN 'warning' WHEN negative_entities >= 0.40 THEN 'watch' ELSE 'none' END AS negative_entities_level FROM v),
  w AS (SELECT *, round(list_sum(list_transform([issue_pressure_level, thread_controversy_level, negative_entities_level], lambda x: CASE x WHEN 'critical' THEN 2.5 WHEN 'warning' THEN 1.8 WHEN 'watch' THEN 1.0 ELSE 0 END::DOUBLE)), 4) AS weight FROM l)
  SELECT *, CASE WHEN 'critical' IN (issue_pressure_level, thread_controversy_level, negative_entities_level) OR weight >= 5 THEN 'critical' WHEN weight >= 2.5 THEN 'warning' WHEN weight >= 0.8 THEN 'watch' ELSE 'normal' END AS crisis_level FROM w""")
def crisis_level(spark, sf_dir):
    return R.crisis(top_issues(spark, sf_dir), thread_controversy(spark, sf_dir), sov_brand(spark, sf_dir))


def emerging(spark, sf_dir):
    """Topics by how many more mentions the later half has."""
    rows = R.buzz(event_topics(spark, sf_dir), "topic")
    return rows.select("topic", (F.col("current_count") - F.col("previous_count")).alias("growth_delta"))


@query(f"""WITH s AS (SELECT * FROM ({ORACLE_SQL['sov_brand']}) ORDER BY mention_share DESC, hit_share DESC, entity_id LIMIT 1), b AS (SELECT * FROM ({BUZZ}) ORDER BY buzz_score_proxy DESC, effective_mention_count DESC, topic LIMIT 1),
  n AS (SELECT topic, current_count - previous_count AS d FROM ({BUZZ}) ORDER BY d DESC, topic LIMIT 1), i AS (SELECT * FROM ({DETAILED_ISSUES}) ORDER BY issue_pressure_proxy DESC, mention_count DESC, issue_category LIMIT 1),
  t AS (SELECT * FROM ({TOP_CONTROVERSY}) LIMIT 1), c AS (SELECT * FROM ({CREATORS}) ORDER BY mention_count DESC, author_id LIMIT 1),
  cards AS (SELECT 'share_of_voice_shift' AS insight_type, 'Share of voice shift detected for ' || entity_id AS title, entity_id || CASE WHEN delta_mention_count > 0 THEN ' gained ' ELSE ' lost ' END || abs(delta_mention_count) || ' mention(s) in the later half of the window.' AS summary,
    delta_mention_share AS metric, least(0.55::DOUBLE + abs(delta_mention_share), 0.9::DOUBLE) AS confidence, array_to_string(evidence, ',') AS evidence, 'entity_id' AS filter_key, entity_id AS filter_value, 'sov_report,buzz_report' AS source_reports FROM s WHERE delta_mention_count <> 0
  UNION ALL SELECT 'trending_topic', 'Topic gaining volume: ' || topic, topic || ' is reportable in ' || mention_count || ' raw mentions and ' || printf('%.2f', effective_mention_count) || ' effective mentions.', buzz_score_proxy, least(0.5::DOUBLE + greatest(growth, 0) * 0.1::DOUBLE, 0.86::DOUBLE), '', 'topic', topic, 'buzz_report' FROM b
  UNION ALL SELECT 'conversation_hotspot', 'Topic buzz concentrating around ' || topic, topic || ' appears in ' || mention_count || ' mentions.', buzz_score_proxy, least(0.52::DOUBLE + greatest(growth, 0) * 0.12::DOUBLE, 0.88::DOUBLE), '', 'topic', topic, 'buzz_report' FROM b
  UNION ALL SELECT 'emerging_topic', 'Emerging topic: ' || topic, topic || ' passed quality gates with growth delta ' || printf('%.1f', CAST(d AS DOUBLE)) || '.', d, 0.54, '', 'topic', topic, 'emerging_topics_report' FROM n
  UNION ALL SELECT 'issue_warning', 'Issue pressure around ' || issue_category, issue_category || ' leads the issue report across ' || mention_count || ' mentions.', issue_pressure_proxy, least(0.58::DOUBLE + issue_pressure_proxy / greatest(issue_pressure_proxy, 1) * 0.18::DOUBLE, 0.86::DOUBLE), array_to_string(evidence, ','), 'issue_category', issue_category, 'top_issues_report' FROM i
  UNION ALL SELECT 'controversy_alert', 'Controversy proxy elevated for thread ' || root_id, 'Thread ' || root_id || ' stands out by reply density, recursion, polarity conflict, and diversity signals.', controversy_score_proxy, least(0.52::DOUBLE + controversy_score_proxy * 0.25::DOUBLE, 0.84::DOUBLE), '', 'root_id', root_id, 'thread_controversy_report' FROM t
  UNION ALL SELECT 'creator_concentration', 'Creator concentration around ' || author_id, author_id || ' contributed ' || mention_count || ' mentions, or ' || printf('%.2f', 100 * conversation_share) || '% of the slice.', conversation_share, least(0.5::DOUBLE + conversation_share * 0.5::DOUBLE, 0.8::DOUBLE), array_to_string(evidence, ','), 'author_id', CAST(author_id AS VARCHAR), 'creator_source_breakdown_report' FROM c)
  SELECT * REPLACE (CAST(metric AS DOUBLE) AS metric, round(CAST(confidence AS DOUBLE), 6) AS confidence) FROM cards""")
def insight_cards(spark, sf_dir):
    return R.insight_cards(sov_brand(spark, sf_dir), buzz_event_type(spark, sf_dir), emerging(spark, sf_dir), top_issues(spark, sf_dir), thread_controversy(spark, sf_dir), creators(spark, sf_dir))


@query(f"SELECT * FROM ({ORACLE_SQL['insight_cards']}) WHERE confidence >= 0.3")
def digest_payload(spark, sf_dir):
    """The cards that are certain enough to be published, as they go out."""
    return insight_cards(spark, sf_dir).filter("confidence >= 0.3")
