"""Queries on stores, dimensions, scores and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import entities, nlp, store
from ..sources import envelopes
from . import adapters as A
from . import payloads as P
from . import reports as R
from .registry import listing

QUERIES, ORACLE_SQL, query = listing()

REVIEW = "SELECT 'item-' || doc_id AS item_id, source AS project_id, CASE doc_id % 7 WHEN 0 THEN 'entity' WHEN 1 THEN 'sentiment' WHEN 2 THEN 'keyword' ELSE 'issue' END AS fact_type, round((doc_id % 100) / 100.0::DOUBLE, 2) AS confidence, doc_id AS created_at FROM documents"


def review_facts(spark, sf_dir):
    k = F.col("doc_id")
    return A.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("item-"), k).alias("item_id"), F.col("source").alias("project_id"), F.when(k % 7 == 0, "entity").when(k % 7 == 1, "sentiment").when(k % 7 == 2, "keyword").otherwise("issue").alias("fact_type"),
        F.round((k % 100) / 100, 2).alias("confidence"), k.alias("created_at"))


@query(f"SELECT * FROM ({REVIEW}) WHERE fact_type IN ('entity', 'sentiment', 'stance', 'intent', 'aspect', 'issue') AND confidence < 0.65 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at, item_id) <= 5000")
def review_queue(spark, sf_dir):
    return store.queued(review_facts(spark, sf_dir))


@query("SELECT count(*) FILTER (k NOT IN (0, 1, 2)) AS pending, count(*) FILTER (k = 0) AS approved, count(*) FILTER (k = 1) AS rejected, count(*) FILTER (k = 2) AS skipped FROM (SELECT doc_id % 5 AS k FROM documents)")
def review_summary(spark, sf_dir):
    ids = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    k = F.col("item_id") % 5
    first = ids.select("item_id", F.lit("pending").alias("status"), F.lit(1).alias("at"))
    then = ids.select("item_id", F.when(k == 0, "approved").when(k == 1, "rejected").when(k == 2, "skipped").alias("status"), F.lit(2).alias("at")).filter("status is not null")
    return store.status_counts(first.union(then))


def stored(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("risk_level"), F.col("o_totalprice").alias("impact_score"), F.col("o_orderdate").alias("analyzed_at"))


STORED = "SELECT o_orderkey AS id, o_custkey AS project_id, o_orderstatus AS risk_level, o_totalprice AS impact_score, o_orderdate AS analyzed_at FROM orders"


@query(f"SELECT * FROM ({STORED}) WHERE risk_level = 'F' ORDER BY impact_score DESC, id LIMIT 25")
def store_list(spark, sf_dir):
    return store.listed(stored(spark, sf_dir), {"risk_level": "F", "project_id": None}, "impact_score", limit=25)


@query(f"WITH s AS ({STORED}) SELECT * FROM s WHERE id % 10 <> 0 UNION ALL SELECT id, project_id, 'X', 0.0, analyzed_at FROM s WHERE id % 10 = 0 UNION ALL SELECT -id, project_id, 'X', 0.0, analyzed_at FROM s WHERE id % 100 = 0 AND id <> 0")
def store_upsert(spark, sf_dir):
    rows = stored(spark, sf_dir)
    changed = rows.withColumns({"risk_level": F.lit("X"), "impact_score": F.lit(0.0)})
    return store.upserted(rows, changed.filter("id % 10 = 0").union(changed.filter("id % 100 = 0 and id != 0").withColumn("id", -F.col("id"))), ["id"])


@query(f"SELECT * FROM ({STORED}) WHERE NOT (risk_level = 'F' AND project_id = 1)")
def store_delete(spark, sf_dir):
    return store.deleted(stored(spark, sf_dir), {"risk_level": "F", "project_id": 1})


@query("SELECT event_id AS id, 'pending' AS status, ts AS created_at FROM events WHERE event_id % 3 = 0 ORDER BY ts, event_id LIMIT 50")
def outbox_relay(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "pending").otherwise("sent").alias("status"), F.col("ts").alias("created_at"))
    return store.relayed(rows)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(isodow(o_orderdate) AS INTEGER) AS weekday FROM orders")
def dim_time(spark, sf_dir):
    day = A.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return day.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.weekofyear("date").alias("week"), (F.weekday("date") + 1).alias("weekday"))


@query("SELECT DISTINCT lang AS project_id, source AS platform FROM documents")
def dim_projects(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(F.col("lang").alias("project_id"), F.col("source").alias("platform")).distinct()


def places(spark, sf_dir):
    regions = A.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    countries = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    firms = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"))
    return regions.union(countries).union(firms)


NODES = "nodes AS (SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(f"WITH RECURSIVE {NODES}, walk AS (SELECT node_id, parent_id, 0 AS depth, node_id AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, depth + 1, path || '/' || n.node_id FROM nodes n JOIN walk w ON n.parent_id = w.node_id) SELECT * FROM walk")
def taxonomy_tree(spark, sf_dir):
    return entities.taxonomy(places(spark, sf_dir))


@query("SELECT count(*) AS dangling FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def taxonomy_check(spark, sf_dir):
    return entities.dangling(A.table(spark, sf_dir, "nation"), "n_regionkey", A.table(spark, sf_dir, "region"), "r_regionkey").agg(F.count("*").alias("dangling"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'overlay' ELSE n_name END AS n_name FROM nation")
def ontology_overlay(spark, sf_dir):
    base = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return entities.overlay(base, base.filter("n_regionkey = 1").withColumn("n_name", F.lit("overlay")), "n_nationkey").select("n_nationkey", "n_name")


TABLES = ("documents", "events", "conversations", "orders", "lineitem", "part", "nation", "region", "labels", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS mart, count(*) AS rows FROM {t}" for t in TABLES))
def mart_counts(spark, sf_dir):
    parts = [A.table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("mart"), "rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


ENGAGED = "e AS (SELECT user_id AS author_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS likes, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS comments, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS shares, CAST(sum(value) AS BIGINT) AS views, avg(value) AS mood FROM events GROUP BY 1)"
IMPACT = f"""WITH {ENGAGED}, s AS (SELECT *, least(CASE WHEN views >= 100 THEN (likes + 2 * comments + 3 * shares) / CAST(views AS DOUBLE) * 100 ELSE CAST(likes + 2 * comments + 3 * shares AS DOUBLE) END, 100.0) AS engagement,
    shares / CAST(likes + comments + 1 AS DOUBLE) AS virality, log10(views + 1) * CASE WHEN author_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS reach FROM e)
  SELECT author_id, round(engagement, 4) AS engagement, round(virality, 4) AS virality, round(reach, 4) AS reach, round(least(greatest(engagement * reach * CASE author_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.2::DOUBLE ELSE 1.5::DOUBLE END * CASE WHEN mood < 10 THEN 1.5::DOUBLE ELSE 1.1::DOUBLE END / 100000.0 * 100, 0.0), 100.0), 6) AS impact FROM s"""


def engaged(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("author_id")).agg(n("click").alias("likes"), n("view").alias("comments"), n("purchase").alias("shares"), F.round(F.sum("value")).cast("bigint").alias("views"), F.avg("value").alias("mood"))


@query(IMPACT)
def impact_score(spark, sf_dir):
    rows = engaged(spark, sf_dir).withColumns({
        "engagement": S.engagement(F.col("likes"), F.col("comments"), F.col("shares"), F.col("views")), "virality": S.virality(F.col("likes"), F.col("comments"), F.col("shares")), "reach": S.reach(F.col("views"), F.col("author_id") % 2 == 0)})
    platform = F.when(F.col("author_id") % 3 == 0, "tiktok").when(F.col("author_id") % 3 == 1, "facebook").otherwise("youtube")
    mood = F.when(F.col("mood") < 10, "NEGATIVE").otherwise("POSITIVE")
    return rows.select("author_id", *[F.round(c, 4).alias(c) for c in ("engagement", "virality", "reach")], F.round(S.impact(F.col("engagement"), F.col("reach"), platform, mood), 6).alias("impact"))


@query("""WITH r AS (SELECT event_id, (value - 25) / 25 AS s, (event_id % 10) / 10.0::DOUBLE AS v, event_type = 'error' AS k FROM events), b AS (SELECT *, CASE WHEN s < -0.3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN s < -0.7 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN k THEN 0.4::DOUBLE ELSE 0 END AS base FROM r),
  f AS (SELECT event_id, CASE WHEN base >= 0.3 AND v > 0.1 THEN base * (1 + v) ELSE base END AS risk FROM b) SELECT event_id, round(risk, 4) AS risk, CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM f""")
def risk_level(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").withColumn("text", F.when(F.col("event_type") == "error", "a scandal").otherwise("fine"))
    rows = rows.withColumn("r", S.risk((F.col("value") - 25) / 25, F.col("text"), (F.col("event_id") % 10) / 10))
    return rows.select("event_id", F.round("r", 4).alias("risk"), S.risk_level(F.col("r")).alias("level"))


@query("SELECT event_type, max(value) AS top, arg_max(event_id, struct_pack(a := value, b := -event_id)) AS event_id FROM events GROUP BY 1")
def intent_priority(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("top"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


def envelopes_of(spark, sf_dir):
    """events as messages: nested, flat and broken ones."""
    k = F.col("event_id")
    nested = F.to_json(F.struct(F.lit("1.0").alias("uap_version"), F.struct(F.lit("p1").alias("project_id")).alias("ingest"), F.struct(k.cast("string").alias("doc_id"), F.lit("comment").alias("doc_type"), F.col("props").alias("text")).alias("content"),
                               F.struct(F.struct(k.cast("string").alias("like_count")).alias("engagement")).alias("signals")))
    flat = F.to_json(F.struct(F.struct(k.cast("string").alias("uap_id"), F.when(k % 4 == 2, F.lit("p2")).alias("project_id")).alias("identity"), F.struct(F.lit("x").alias("likes")).alias("engagement")))
    return A.table(spark, sf_dir, "events").select(F.when(k % 4 == 0, nested).when(k % 4 < 3, flat).otherwise(F.lit("{\"other\": 1}")).alias("value"))


@query("""WITH r AS (SELECT event_id % 4 AS k, event_id FROM events) SELECT CASE WHEN k = 0 THEN 'nested' WHEN k < 3 THEN 'flat' END AS format, CASE k WHEN 1 THEN 'missing_project_id' WHEN 3 THEN 'unknown_format' END AS reject_reason,
  count(*) AS n, CAST(sum(CASE WHEN k = 0 THEN event_id ELSE 0 END) AS BIGINT) AS likes FROM r GROUP BY ALL""")
def envelope_parse(spark, sf_dir):
    return envelopes.parsed(envelopes_of(spark, sf_dir)).groupBy("format", "reject_reason").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS depth, count(*) AS n, count(*) FILTER (event_id % 4 = 0 AND event_id > 0) AS scored FROM events WHERE event_id % 4 IN (0, 2) GROUP BY 1")
def silver_mentions(spark, sf_dir):
    rows = envelopes.mentions(envelopes.accepted(envelopes.parsed(envelopes_of(spark, sf_dir))))
    return rows.groupBy("depth").agg(F.count_distinct("mention_id").alias("n"), F.count("sort_score").alias("scored"))


@query(r"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('p:' || doc_id)) AS d FROM documents) SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  substr('89ab', 1 + CAST('0x' || substr(d, 17, 1) AS INTEGER) % 4, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS mention_id FROM h""")
def mention_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.uuid5(envelopes.NAMESPACE, F.concat(F.lit("p:"), "doc_id")).alias("mention_id"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE rtrim(substr(text, 1, 100)) || '...' END AS snippet, lower(source) AS platform, length(text) >= 10 AS should_index FROM documents WHERE length(text) > 0")
def publish_documents(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return rows.select("doc_id", T.snippet(F.col("text")).alias("snippet"), F.lower("source").alias("platform"), (F.length("text") >= 10).alias("should_index"))


@query("SELECT * FROM labels WHERE quality = 1 UNION ALL SELECT * FROM labels WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality = 1)")
def reportable_fallback(spark, sf_dir):
    return R.reportable(A.table(spark, sf_dir, "labels"), "quality", 1)


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)showroom') OR doc_id % 5 = 1 THEN 'SUPPORT' WHEN doc_id % 5 = 0 THEN 'CRISIS' WHEN doc_id % 5 = 2 THEN 'SPAM' ELSE 'DISCUSSION' END AS intent,
  CASE doc_id % 5 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence, doc_id % 5 = 2 AS skip FROM documents""")
def intent_classifier(spark, sf_dir):
    k = F.col("doc_id") % 5
    cue = F.when(k == 0, " Scam phốt showroom").when(k == 1, " SHOWROOM").when(k == 2, " vay  vốn").otherwise("")
    rows = A.table(spark, sf_dir, "documents").select("doc_id", nlp.intent(F.concat(F.col("text"), cue)).alias("r"))
    return rows.select("doc_id", "r.*")


@query("""WITH s AS (SELECT user_id AS mention_id, event_type AS aspect, (event_id % 17 - 8) / 8.0::DOUBLE AS score, (event_id % 8 + 1) / 8.0::DOUBLE AS confidence, event_id % 5 + 1 AS rating FROM events),
  g AS (SELECT mention_id, aspect, round(sum(score * confidence) / sum(confidence), 4) AS score, round(avg(confidence), 4) AS confidence, CAST(round(avg(rating)) AS INTEGER) AS rating, count(*) AS mentions FROM s GROUP BY ALL)
  SELECT *, CASE WHEN score > 0.25 THEN 'POSITIVE' WHEN score < -0.25 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM g""")
def aspect_sentiment(spark, sf_dir):
    k = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("mention_id"), F.col("event_type").alias("aspect"), ((k % 17 - 8) / 8).alias("score"), ((k % 8 + 1) / 8).alias("confidence"), (k % 5 + 1).alias("rating"))
    return nlp.aspect_sentiment(rows)


@query("""SELECT user_id AS mention_id, round(least(least(count(*) / 30.0::DOUBLE, 1.0) + least(count(DISTINCT event_type) / 4.0::DOUBLE, 0.2) + least(count(DISTINCT event_id % 3) / 5.0::DOUBLE, 0.15) + least(var_pop(value / 100), 0.15), 1.0::DOUBLE), 6) AS confidence FROM events GROUP BY 1""")
def keyword_confidence(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events")
    return nlp.keyword_confidence(rows.select(F.col("user_id").alias("mention_id"), F.col("event_type").alias("type"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 3).alias("entity_type")))


@query(r"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents), w AS (SELECT * FROM (VALUES ('price', 'the'), ('quality', 'in the'), ('price', 'zu')) v(aspect, term))
  SELECT doc_id AS mention_id, term, aspect FROM d JOIN w ON contains(t, ' ' || term || ' ')""")
def dictionary_keywords(spark, sf_dir):
    terms = spark.createDataFrame([("price", "the"), ("quality", "in the"), ("price", "zu")], "aspect string, term string")
    return nlp.dictionary_keywords(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mention_id"), "text"), terms)


@query()
def keyword_context(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", nlp.context(F.col("text"), F.lit("trash")).alias("context"))


def results(spark, sf_dir):
    k = F.col("doc_id")
    return A.table(spark, sf_dir, "documents").select(
        k.alias("id"), F.col("lang").alias("project_id"), F.upper("source").alias("platform"), F.when(k % 4 == 0, "SPAM").otherwise("LEAD").alias("intent"), (k % 6 == 1).alias("is_spam"),
        F.when(k % 3 == 0, "HIGH").otherwise("LOW").alias("risk_level"), F.when(k % 2 == 0, "neg").otherwise("odd").alias("sentiment"), "text")


@query("SELECT doc_id AS id, lower(source) AS platform, CASE WHEN doc_id % 3 = 0 THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS risk_score, doc_id % 4 = 0 OR doc_id % 6 = 1 AS is_spam, doc_id % 3 = 0 AS requires_attention FROM documents")
def store_projection(spark, sf_dir):
    return P.store_rows(results(spark, sf_dir)).select("id", "platform", "risk_score", "is_spam", "requires_attention")


@query("SELECT doc_id AS id, 'OTHER' AS platform, CASE WHEN doc_id % 2 = 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment, doc_id % 3 = 0 AS alert, length(text) >= 10 AND doc_id % 4 <> 0 AS should_index FROM documents")
def insight_messages(spark, sf_dir):
    m = F.col("message")
    got = lambda path: F.get_json_object(m, path)
    return P.messages(results(spark, sf_dir)).select("id", got("$.identity.platform").alias("platform"), got("$.nlp.sentiment").alias("sentiment"), (got("$.business.alert") == "true").alias("alert"), (got("$.rag.should_index") == "true").alias("should_index"))


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS window, 'run-' || strftime(min(ts), '%Y%m%dT%H%M%SZ') AS run_id FROM events GROUP BY 1")
def window_labels(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("event_type", P.window_label(F.col("a"), F.col("b")).alias("window"), P.run_id(F.col("a")).alias("run_id"))


@query()
def report_contracts(spark, sf_dir):
    return P.contracts(spark)
