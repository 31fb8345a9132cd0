"""Queries on mentions: duplicates, spam, threads, topics, entities, text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import scores as S
from ..functions import text as T
from ..operators import dedup, entities, semantics, spam, threads, topics, windows
from . import adapters as A
from .registry import listing

QUERIES, ORACLE_SQL, query = listing()

MENTIONS = r"""m AS (SELECT doc_id AS mention_id, source AS author_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
  c AS (SELECT *, trim(regexp_replace(translate(regexp_replace(lower(text), '[^\p{L}\p{N}_\s#:/+-]', ' ', 'g'), '/_', '  '), '\s+', ' ', 'g')) AS compact FROM m)"""
EXACT = f"""{MENTIONS},
  p AS (SELECT *, sha256(compact) AS fp FROM c WHERE length(compact) >= 10),
  e AS (SELECT fp, 'exact:' || substr(fp, 1, 16) AS cluster_id, count(*) AS cluster_size, arg_min(mention_id, struct_pack(a := -length(compact), b := mention_id)) AS representative_id FROM p GROUP BY fp HAVING count(*) >= 2),
  x AS (SELECT p.mention_id, e.cluster_id, e.cluster_size, e.representative_id FROM p JOIN e USING (fp))"""


@query(f"WITH {EXACT} SELECT cluster_id, cluster_size, representative_id FROM e")
def dedup_exact_clusters(spark, sf_dir):
    return dedup.exact_clusters(A.mentions(spark, sf_dir)).drop("_print")


@query(f"WITH {EXACT} SELECT m.mention_id, x.cluster_id AS dedup_cluster_id, coalesce(x.cluster_size, 1) AS dedup_cluster_size, round(1.0::DOUBLE / coalesce(x.cluster_size, 1), 6) AS dedup_weight FROM m LEFT JOIN x USING (mention_id)")
def dedup_weights(spark, sf_dir):
    rows = A.mentions(spark, sf_dir)
    return dedup.annotated(rows, dedup.exact_members(rows)).select("mention_id", "dedup_cluster_id", F.col("dedup_cluster_size").cast("long").alias("dedup_cluster_size"), "dedup_weight")


PAIRS = f"""{EXACT},
  rest AS (SELECT * FROM c WHERE mention_id NOT IN (SELECT mention_id FROM x)),
  t AS (SELECT mention_id, list_filter(string_split(compact, ' '), lambda w: w <> '') AS w FROM rest),
  s AS (SELECT mention_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN length(array_to_string(w, '')) >= 5 THEN list_transform(range(1, length(array_to_string(w, '')) - 3), lambda i: substr(array_to_string(w, ''), i, 5))
    WHEN length(array_to_string(w, '')) > 0 THEN [array_to_string(w, '')] ELSE [] END) AS sh FROM t),
  u AS (SELECT mention_id, len(sh) AS n, unnest(sh) AS g FROM s),
  o AS (SELECT a.mention_id AS a, b.mention_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.mention_id < b.mention_id GROUP BY ALL),
  pairs AS (SELECT a, b, round(k / CAST(na + nb - k AS DOUBLE), 4) AS similarity FROM o WHERE round(k / CAST(na + nb - k AS DOUBLE), 4) >= 0.82)"""


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def dedup_near_pairs(spark, sf_dir):
    rows = A.mentions(spark, sf_dir)
    return dedup.near_pairs(rows, without=dedup.copied(rows))


@query(f"""WITH RECURSIVE {PAIRS}, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), nodes AS (SELECT DISTINCT a AS n FROM links),
  walk AS (SELECT n, n AS r FROM nodes UNION SELECT w.n, l.b FROM walk w JOIN links l ON l.a = w.r), k AS (SELECT n AS mention_id, min(r) AS component FROM walk GROUP BY n),
  z AS (SELECT component, count(*) AS cluster_size, arg_min(c.mention_id, struct_pack(a := -length(c.compact), b := c.mention_id)) AS representative_id FROM k JOIN c USING (mention_id) GROUP BY component),
  v AS (SELECT component, round(avg(similarity), 4) AS similarity FROM pairs JOIN k ON k.mention_id = pairs.a GROUP BY component)
  SELECT k.mention_id, 'near:' || substr(sha256(CAST(component AS VARCHAR)), 1, 16) AS cluster_id, cluster_size, representative_id, similarity FROM k JOIN z USING (component) JOIN v USING (component)""")
def dedup_near_clusters(spark, sf_dir):
    return dedup.near_clusters(A.mentions(spark, sf_dir))


def scored(spark, sf_dir):
    rows = A.mentions(spark, sf_dir)
    return spam.scored(dedup.annotated(rows, dedup.exact_members(rows)))


SCORED = rf"""{EXACT},
  w AS (SELECT c.*, regexp_extract_all(compact, '[\p{{L}}\p{{N}}_]+') AS tok, len(list_distinct(regexp_extract_all(text, 'https?://\S+'))) AS urls, coalesce(x.cluster_size, 1) AS size FROM c LEFT JOIN x USING (mention_id)),
  q AS (SELECT mention_id, max(n) AS most FROM (SELECT mention_id, t, count(*) AS n FROM (SELECT mention_id, unnest(tok) AS t FROM w) GROUP BY ALL) GROUP BY mention_id),
  f AS (SELECT w.*, len(tok) AS n, CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / CAST(len(tok) AS DOUBLE) ELSE 1.0 END AS div, CASE WHEN len(tok) > 0 THEN most / CAST(len(tok) AS DOUBLE) ELSE 0.0 END AS share,
    (compact LIKE 'rt %' OR compact LIKE 'repost %' OR compact LIKE 'shared from %') AS repost,
    trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '<url>', ' <url> '), '#[\p{{L}}\p{{N}}_]+', ' <tag> ', 'g'), '[0-9]+', ' <num> ', 'g'), '\s+', ' ', 'g')) AS template FROM w LEFT JOIN q USING (mention_id)),
  parts AS (SELECT *, least(urls / CAST(greatest(n, 1) AS DOUBLE) * 2.5, 1.0) AS p1, CASE WHEN n >= 4 THEN greatest(0.0::DOUBLE, 0.45 - div) / 0.45 ELSE 0.0 END AS p2, CASE WHEN n > 0 THEN greatest(1 - div, share) ELSE 0.0 END AS p3,
    (size - 1) / CAST(size AS DOUBLE) AS p4, CASE WHEN repost THEN 1.0 ELSE 0.0 END AS p5, count(*) OVER (PARTITION BY template) AS template_uses FROM f),
  scored AS (SELECT *, round(least(p1 * 0.22::DOUBLE + p2 * 0.22::DOUBLE + p3 * 0.20::DOUBLE + p4 * 0.22::DOUBLE + p5 * 0.14::DOUBLE, 1.0::DOUBLE), 4) AS mention_spam_score FROM parts)"""


@query(f"WITH {SCORED} SELECT mention_id, mention_spam_score, mention_spam_score >= 0.65 AS suspicious, template_uses, array_to_string(list_filter([CASE WHEN p1 >= 0.5 THEN 'high_url_density' END, CASE WHEN p2 >= 0.5 THEN 'low_lexical_diversity' END, CASE WHEN p3 >= 0.5 THEN 'high_repetition_ratio' END, CASE WHEN p4 >= 0.5 THEN 'duplicate_cluster_participation' END, CASE WHEN p5 >= 0.5 THEN 'repost_like_behavior' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scored")
def spam_mention_score(spark, sf_dir):
    return scored(spark, sf_dir).select("mention_id", "mention_spam_score", "suspicious", "template_uses", F.array_join("reasons", ",").alias("reasons"))


BURSTS = """bursts AS (SELECT author_id, count(*) AS posts, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(max(n) / CAST(count(*) AS DOUBLE), 4) END AS burstiness FROM
    (SELECT user_id AS author_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1)"""


@query(f"WITH {BURSTS} SELECT * FROM bursts")
def author_burstiness(spark, sf_dir):
    return windows.burstiness(A.timed(spark, sf_dir), "author_id", "posted_at")


def profiles(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows, spam.authors(rows, rows.select("author_id").distinct().withColumn("burstiness", F.lit(0.25)))


AUTHORS = f"""{SCORED},
  g AS (SELECT author_id, count(*) AS mention_count, count(*) FILTER (mention_spam_score >= 0.65) AS suspicious_mention_count, sum(CAST(round(mention_spam_score * 10000) AS BIGINT)) AS s, sum(CAST(round(mention_spam_score * 10000) AS BIGINT)) / (count(*) * 10000)::DOUBLE AS a, count(*) FILTER (size > 1) / CAST(count(*) AS DOUBLE) AS d,
    count(*) FILTER (template_uses >= 3) / CAST(count(*) AS DOUBLE) AS t, count(*) FILTER (repost) / CAST(count(*) AS DOUBLE) AS r FROM scored GROUP BY 1),
  h AS (SELECT *, round(least(a * 0.42::DOUBLE + 0.25::DOUBLE * 0.18::DOUBLE + d * 0.20::DOUBLE + t * 0.12::DOUBLE + r * 0.08::DOUBLE, 1.0::DOUBLE), 4) AS base, (d >= 0.45)::INT + (t >= 0.45)::INT + (r >= 0.4)::INT + (a >= 0.55)::INT AS reasons FROM g),
  profiles AS (SELECT author_id, mention_count, suspicious_mention_count, round(least(base + least(reasons * 0.03::DOUBLE, 0.09::DOUBLE), 1.0::DOUBLE), 4) AS author_inorganic_score, round(t, 4) AS template_ratio, round(d, 4) AS duplicate_rate, round(r, 4) AS repost_ratio, ((2 * s + mention_count) // (2 * mention_count)) / 10000.0::DOUBLE AS average_spam_score FROM h)"""


@query(f"WITH {AUTHORS} SELECT * FROM profiles")
def author_profile(spark, sf_dir):
    return profiles(spark, sf_dir)[1].drop("burstiness", "reasons", "author_suspicious")


@query(f"WITH {AUTHORS} SELECT s.mention_id, round((round(1.0::DOUBLE / size, 6)) * greatest(1 - mention_spam_score * 0.65::DOUBLE, 0.15::DOUBLE) * greatest(1 - author_inorganic_score * 0.45::DOUBLE, 0.15::DOUBLE), 6) AS quality_weight FROM scored s JOIN profiles USING (author_id)")
def quality_weight(spark, sf_dir):
    return spam.weighted(*profiles(spark, sf_dir)).select("mention_id", "quality_weight")


THREADS = "t AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS up, CAST(conv_id AS VARCHAR) AS root_id, conv_id, turn, least(turn, 2) AS depth, role, length(text) AS score FROM conversations)"


@query(f"WITH {THREADS} SELECT up AS src, id AS dst, depth FROM t WHERE up IN (SELECT id FROM t)")
def thread_edges(spark, sf_dir):
    return threads.edges(A.thread_mentions(spark, sf_dir))


@query(f"""WITH RECURSIVE {THREADS}, walk AS (SELECT id, up AS at, CAST([] AS VARCHAR[]) AS lineage FROM t UNION ALL SELECT w.id, t.up, list_prepend(t.id, w.lineage) FROM walk w JOIN t ON t.id = w.at)
  SELECT id, arg_max(lineage, len(lineage)) AS lineage FROM walk GROUP BY id""")
def thread_lineage(spark, sf_dir):
    return threads.lineage(A.thread_mentions(spark, sf_dir))


@query(f"WITH {THREADS}, k AS (SELECT up, count(*) AS n FROM t WHERE up IS NOT NULL GROUP BY 1) SELECT t.id, t.up AS parent_id, coalesce(k.n - 1, 0) AS siblings, coalesce(c.n, 0) AS children FROM t LEFT JOIN k ON k.up = t.up LEFT JOIN k c ON c.up = t.id")
def thread_siblings(spark, sf_dir):
    return threads.siblings(A.thread_mentions(spark, sf_dir))


@query(f"""WITH {THREADS}, r AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY score DESC NULLS LAST, depth, id) AS k FROM t WHERE depth > 0),
  b AS (SELECT root_id, list(id ORDER BY k) AS top_comment_ids FROM r WHERE k <= 5 GROUP BY 1)
  SELECT root_id, count(*) AS total_mentions, max(depth) AS max_depth_observed, count(*) FILTER (depth = 1) AS comment_count, count(*) FILTER (depth >= 2) AS reply_count, coalesce(any_value(b.top_comment_ids), []) AS top_comment_ids FROM t LEFT JOIN b USING (root_id) GROUP BY root_id""")
def thread_summary(spark, sf_dir):
    return threads.summaries(A.thread_mentions(spark, sf_dir))


STOP = ", ".join(f"'{w}'" for w in topics.STOPWORDS)
TOPS = rf"""{MENTIONS}, l AS (SELECT mention_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP})) AS w FROM m),
  e AS (SELECT mention_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM l), n AS (SELECT mention_id, token, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL),
  tops AS (SELECT mention_id, token, n, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM n QUALIFY rank <= 8)"""
SHARING = f"""{TOPS}, sharing AS (SELECT a.mention_id AS a, b.mention_id AS b, count(*) AS shared FROM tops a JOIN tops b ON a.token = b.token AND a.mention_id < b.mention_id GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {TOPS} SELECT * FROM tops")
def topic_tokens(spark, sf_dir):
    return topics.top_tokens(A.mentions(spark, sf_dir))


@query(f"WITH {SHARING} SELECT * FROM sharing")
def topic_pairs(spark, sf_dir):
    return topics.sharing_pairs(topics.top_tokens(A.mentions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SHARING}, links AS (SELECT a, b FROM sharing UNION SELECT b, a FROM sharing), walk AS (SELECT a AS n, a AS r FROM links UNION SELECT w.n, l.b FROM walk w JOIN links l ON l.a = w.r),
  comp AS (SELECT n AS mention_id, min(r) AS component FROM walk GROUP BY n), terms AS (SELECT component, token, sum(n) AS uses FROM tops JOIN comp USING (mention_id) GROUP BY ALL),
  best AS (SELECT component, string_agg(token, ' ' ORDER BY k) AS label, string_agg(token, '_' ORDER BY token) AS name FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY uses DESC, token) AS k FROM terms) WHERE k <= 3 GROUP BY 1)
  SELECT 'topic-' || substr(md5(name), 1, 8) AS topic_key, component AS first_mention, label, count(*) AS mentions, round(least(0.35::DOUBLE + 0.05::DOUBLE * count(*), 0.85::DOUBLE), 4) AS confidence FROM comp JOIN best USING (component) GROUP BY component, label, name""")
def topic_clusters(spark, sf_dir):
    return topics.clusters(topics.top_tokens(A.mentions(spark, sf_dir)))


@query(f"""WITH {TOPS}, early AS (SELECT token, count(*) AS mentions FROM tops JOIN documents ON doc_id = mention_id WHERE doc_id < 500 GROUP BY 1), late AS (SELECT token, count(*) AS mentions FROM tops JOIN documents ON doc_id = mention_id WHERE doc_id >= 500 GROUP BY 1)
  SELECT late.token, late.mentions, late.mentions - coalesce(early.mentions, 0) AS growth_delta FROM late LEFT JOIN early USING (token) ORDER BY growth_delta DESC, late.token LIMIT 10""")
def emerging_topics(spark, sf_dir):
    tops = topics.top_tokens(A.mentions(spark, sf_dir))
    count = lambda part: tops.filter(part).groupBy("token").agg(F.count("*").alias("mentions"))
    return topics.emerging(count("mention_id >= 500"), count("mention_id < 500")).orderBy(F.desc("growth_delta"), "token").limit(10)


@query(r"""WITH p AS (SELECT page_id, html FROM pages) SELECT page_id, list_distinct(regexp_extract_all(html, 'https?://\S+')) IS NOT NULL AS has_urls, len(list_distinct(regexp_extract_all(html, 'https?://\S+'))) AS urls,
  len(list_distinct(list_transform(regexp_extract_all(html, '#([\p{L}\p{N}_-]+)', 1), lambda x: lower(x)))) AS hashtags FROM p""")
def hashtags_urls(spark, sf_dir):
    rows = A.table(spark, sf_dir, "pages")
    return rows.select("page_id", T.urls(F.col("html")).isNotNull().alias("has_urls"), F.size(T.urls(F.col("html"))).cast("long").alias("urls"), F.size(T.hashtags(F.col("html"))).cast("long").alias("hashtags"))


@query(rf"WITH {SCORED} SELECT template, count(*) AS uses FROM scored GROUP BY 1 HAVING count(*) >= 3")
def template_keys(spark, sf_dir):
    keyed = A.mentions(spark, sf_dir).select(T.template_key(F.col("normalized")).alias("template"))
    return keyed.groupBy("template").agg(F.count("*").alias("uses")).filter("uses >= 3")


def like(words):
    return " OR ".join(f"text LIKE '%{w}%'" for w in words)


def rules_sql(rules, fallback, label):
    cases = [(f"text LIKE '%?%' OR {like(w)}" if k == 0 else like(w), name, conf) for k, (name, (w, conf)) in enumerate(rules.items())]
    when = lambda pick: " ".join(f"WHEN {c} THEN {pick(n, v)}" for c, n, v in cases)
    return f"""SELECT conv_id, turn, CASE {when(lambda n, v: f"'{n}'")} ELSE '{fallback[0]}' END AS {label}, CASE {when(lambda n, v: f'{v}::DOUBLE')} ELSE {fallback[1]}::DOUBLE END AS confidence FROM conversations"""


@query(rules_sql(S.STANCE_WORDS, ("neutral", 0.45), "stance"))
def stance_rules(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.stance(F.col("text"), F.col("text")).alias("r"))
    return rows.select("conv_id", "turn", "r.*")


@query(rules_sql(S.INTENT_WORDS, ("commentary", 0.4), "intent"))
def intent_rules(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.intent(F.col("text"), F.col("text")).alias("r"))
    return rows.select("conv_id", "turn", "r.*")


@query("SELECT event_id AS mention_id, CASE WHEN value + 2 * (event_id % 40) + event_id / 100.0 >= 500 THEN 'macro' WHEN value + 2 * (event_id % 40) + event_id / 100.0 >= 100 THEN 'mid' WHEN value + 2 * (event_id % 40) + event_id / 100.0 >= 20 THEN 'micro' ELSE 'nano' END AS influence_tier FROM events")
def influence_tier(spark, sf_dir):
    more = F.col("mention_id") % 40
    return A.timed(spark, sf_dir).select("mention_id", S.influence_tier(F.col("value"), more, more, F.col("mention_id")).alias("influence_tier"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '#([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g')) = '' AS blank FROM documents""")
def clean_text_blank(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", (T.clean_text(F.col("text")) == "").alias("blank"))


@query()
def clean_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(T.nfkc(F.col("text"))).alias("clean_text"))


@query(r"""WITH c AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean FROM documents) SELECT doc_id, length(clean) AS total_length, length(clean) < 10 AS is_too_short,
  round(len(regexp_extract_all(text, '#[\p{L}\p{N}_]+')) / CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS DOUBLE), 4) AS hashtag_ratio, round(1 - length(clean) / CAST(length(text) AS DOUBLE), 4) AS reduction_ratio,
  regexp_matches(text, '(03|05|07|08|09|01[2689])\d{8}') AS has_phone, (lower(text) LIKE '%vay vốn%' OR lower(text) LIKE '%lãi suất%' OR lower(text) LIKE '%giải ngân%' OR lower(text) LIKE '%bán sim%' OR lower(text) LIKE '%tuyển dụng%') AS has_spam_keyword FROM c""")
def text_stats(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", T.text_stats(F.col("text"), F.lower(T.squeeze(F.col("text")))).alias("s")).select("doc_id", "s.*")
    return rows.withColumn("total_length", F.col("total_length").cast("long"))


@query(r"""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id, length(trim(text)) < 5 OR (len(w) > 0 AND len(list_distinct(w)) / CAST(len(w) AS DOUBLE) < 0.3) OR """ + " OR ".join(f"contains(lower(text), '{w}')" for w in T.ADS_KEYWORDS) + " AS is_spam FROM t")
def spam_simple(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", (F.size(T.simple_spam(F.col("text"))) > 0).alias("is_spam"))


@query(rf"""WITH {MENTIONS}, k AS (SELECT *, list_filter(string_split(compact, ' '), lambda t: t NOT IN ('', 'url', 'mention')) AS w, len(list_distinct(regexp_extract_all(text, 'https?://\S+'))) AS u FROM c),
  f AS (SELECT mention_id, list_sort(list_filter([CASE WHEN len(w) <= 2 AND u = 0 THEN 'low_information' END, CASE WHEN len(w) = 0 THEN 'no_semantic_content' END,
    CASE WHEN (len(w) = 0 AND length(text) > 0) OR (len(w) <= 3 AND lower(text) IN ('ok', 'oke', 'haha', 'hehe', 'nice')) THEN 'reaction_only' END, CASE WHEN len(list_distinct(w)) <= 2 AND len(w) >= 4 THEN 'template_like' END,
    CASE WHEN u >= 2 OR (u > 0 AND len(w) <= 3) THEN 'url_heavy' END], lambda x: x IS NOT NULL)) AS fl FROM k)
  SELECT mention_id, array_to_string(fl, ',') AS flags, CASE WHEN list_contains(fl, 'no_semantic_content') THEN 'no_semantic_content' WHEN list_contains(fl, 'reaction_only') THEN 'reaction_only' WHEN list_contains(fl, 'low_information') THEN 'low_information'
    WHEN list_contains(fl, 'url_heavy') OR list_contains(fl, 'template_like') THEN 'spam_like' ELSE 'normal' END AS label, round(greatest(1.0::DOUBLE - CASE WHEN list_contains(fl, 'reaction_only') THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN list_contains(fl, 'low_information') THEN 0.3::DOUBLE ELSE 0 END
    - CASE WHEN list_contains(fl, 'url_heavy') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN list_contains(fl, 'template_like') THEN 0.2::DOUBLE ELSE 0 END, 0.05::DOUBLE), 4) AS score FROM f""")
def quality_flags(spark, sf_dir):
    rows = A.mentions(spark, sf_dir)
    rows = rows.select("mention_id", T.quality_flags(F.col("text"), F.col("normalized"), F.col("compact"), F.col("urls"), F.array().cast("array<string>"), F.lit(True)).alias("f"))
    return rows.select("mention_id", F.array_join("f", ",").alias("flags"), T.quality_label(F.col("f")).alias("label"), T.quality_score(F.col("f")).alias("score"))


@query()
def language_gate(spark, sf_dir):
    rows = A.mentions(spark, sf_dir).select("mention_id", "text", "compact", L.candidates(F.col("text")).alias("ranked"))
    rows = rows.withColumn("found", L.detected(F.col("text"), F.col("ranked")))
    gate = L.gate(F.col("text"), F.col("compact"), L.canonical(F.col("found.language")))
    return rows.select("mention_id", "found.language", "found.confidence", gate.alias("gate")).select("mention_id", F.col("language").alias("detected"), "confidence", "gate.*")


@query("SELECT lang, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'unknown' END AS canonical, count(*) AS n FROM documents GROUP BY ALL")
def language_labels(spark, sf_dir):
    label = F.concat(F.lit("__label__"), F.upper("lang"), F.lit("_XX"))
    return A.table(spark, sf_dir, "documents").groupBy("lang", L.canonical(label).alias("canonical")).agg(F.count("*").alias("n"))


@query()
def polarity_sentiment(spark, sf_dir):
    return semantics.mention_sentiment(A.mentions(spark, sf_dir))


ANCHORS = " UNION ALL ".join(rf"SELECT doc_id AS mention_id, '{k}' AS category, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: t IN ({', '.join(repr(x) for x in w)}))) AS hits, 0.76::DOUBLE AS confidence FROM documents" for k, w in semantics.ISSUES.items())


@query(f"SELECT mention_id, category, CAST(hits AS INTEGER) AS hits, confidence FROM ({ANCHORS}) WHERE hits > 0")
def aspect_issue_anchors(spark, sf_dir):
    return semantics.anchors(A.mentions(spark, sf_dir), semantics.ISSUES, 0.76)


@query(r"""WITH f AS (SELECT source AS root_id, lang AS category, doc_id AS mention_id, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, count(*) OVER (PARTITION BY source, lang) AS g FROM documents)
  SELECT a.root_id, a.category, a.mention_id, count(*) AS corroborating FROM f a JOIN f b ON a.root_id = b.root_id AND a.category = b.category AND (a.mention_id = b.mention_id OR (a.g > 96 AND a.text = b.text)
    OR (a.g <= 96 AND round(len(list_intersect(a.w, b.w)) / CAST(greatest(1, len(list_distinct(list_concat(a.w, b.w)))) AS DOUBLE), 4) >= 0.52)) GROUP BY ALL""")
def corroboration(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.col("source").alias("root_id"), F.col("lang").alias("category"), F.col("doc_id").alias("mention_id"), "text")
    return semantics.corroboration(rows)


def nations(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation")
    return rows.select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 4)).alias("aliases"), F.col("n_nationkey").alias("ord"))


ALIASES = """al AS (SELECT alias, arg_max(entity_id, ord) AS entity_id FROM (SELECT lower(n_name) AS alias, 'nation:' || n_nationkey AS entity_id, n_nationkey AS ord FROM nation UNION ALL SELECT lower(trim(substr(n_name, 1, 4))), 'nation:' || n_nationkey, n_nationkey FROM nation) GROUP BY 1)"""


@query(f"WITH {ALIASES} SELECT c_custkey AS mention_id, lower(c_mktsegment) AS alias, al.entity_id, CASE WHEN al.entity_id IS NULL THEN 0.40::DOUBLE ELSE 0.78::DOUBLE END AS confidence FROM customer LEFT JOIN al ON al.alias = lower(c_mktsegment)")
def entity_alias_join(spark, sf_dir):
    hits = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), F.concat(F.lit("#"), "c_mktsegment").alias("surface"))
    return entities.resolved(hits, entities.alias_index(nations(spark, sf_dir))).select("mention_id", "alias", "entity_id", "confidence")


@query(r"""WITH names AS (SELECT DISTINCT lower(n_name) AS a, 'nation:' || n_nationkey AS entity_id FROM nation UNION SELECT 'the', 'word:the' UNION SELECT 'of the', 'word:of'),
  d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id AS mention_id, entity_id FROM d JOIN names ON contains(t, ' ' || a || ' ')""")
def entity_text_scan(spark, sf_dir):
    extra = spark.createDataFrame([("word:the", "the", 100), ("word:of", "of the", 101)], "entity_id string, name string, ord int").withColumn("aliases", F.array().cast("array<string>"))
    known = nations(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>")).unionByName(extra)
    return entities.text_scan(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mention_id"), "text"), entities.alias_index(known))


@query("SELECT lower(p_type) AS alias, count(DISTINCT p_partkey) AS mentions, count(*) AS hits, min(p_partkey) AS first_mention, 'cand:' || substr(md5(lower(p_type)), 1, 12) AS cluster_id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def entity_clusters(spark, sf_dir):
    hits = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_type").alias("surface"))
    return entities.unresolved_clusters(entities.resolved(hits, entities.alias_index(nations(spark, sf_dir))))


@query()
def entity_candidates(spark, sf_dir):
    rows = A.mentions(spark, sf_dir).select("mention_id", F.explode(entities.candidates(F.col("text"))).alias("c"))
    return rows.select("mention_id", "c.*", entities.guessed_type(F.col("c.surface")).alias("type"), entities.specificity(F.col("c.surface")).alias("specificity"))


@query()
def text_segments(spark, sf_dir):
    return A.mentions(spark, sf_dir).select("mention_id", F.explode(semantics.segments(F.col("text"))).alias("s")).select("mention_id", "s.*")


@query()
def keyword_topn(spark, sf_dir):
    return topics.keyphrases(A.mentions(spark, sf_dir))
