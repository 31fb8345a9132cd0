from __future__ import annotations

import datetime as dt
import json
import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from chatterlake.functions import language as L
from chatterlake.functions import numbers as N
from chatterlake.functions import scores as S
from chatterlake.functions import text as T
from chatterlake.operators import dedup, entities, nlp, semantics, spam, store, threads, topics, windows
from chatterlake.plans import payloads as P
from chatterlake.plans import reports as R
from chatterlake.plans.pipeline import Options, run_batch
from chatterlake.sources import dictionaries, envelopes, files
from chatterlake.streaming import events as E


def value(spark, column, **given):
    """One column's value on one row of given values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("v")).first()["v"]


def mentions(spark, texts, author="a"):
    rows = spark.createDataFrame([(i, t, author if isinstance(author, str) else author[i]) for i, t in enumerate(texts)], "mention_id long, text string, author_id string")
    rows = rows.withColumns({"depth": F.lit(0), "urls": T.urls(F.col("text")), "hashtags": T.hashtags(F.col("text")), "normalized": F.col("text"), "compact": T.compact(F.col("text"))})
    return rows


def test_exact_dedup_clusters_and_weights(spark):
    rows = mentions(spark, ["the same text here", "The same  text here!", "another text entirely", "short", "short", "the same text here"])
    found = {r.mention_id: r for r in dedup.annotated(rows, dedup.exact_members(rows)).collect()}
    assert [found[i].dedup_cluster_size for i in range(6)] == [3, 3, 1, 1, 1, 3]
    assert found[0].dedup_weight == round(1 / 3, 6) and found[0].dedup_kind == "exact" and found[3].dedup_cluster_id is None
    assert dedup.exact_clusters(rows.limit(0)).count() == 0


def brute_pairs(texts, least=0.82):
    sets = []
    for t in texts:
        w = t.split()
        j = "".join(w)
        sets.append({" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {j[i : i + 5] for i in range(len(j) - 4)} if len(j) >= 5 else {j} - {""})
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4) >= least}


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(80)}" for _ in range(rng.choice([2, 6, 40]))]
        texts += [" ".join(w if rng.random() > 0.03 else "zz" for w in base) for _ in range(6)]
    texts += ["", "ab", "abcdef", "abcdefg"]
    got = {(r.a, r.b) for r in dedup.near_pairs(mentions(spark, texts)).collect()}
    assert got == brute_pairs(texts)


def test_near_clusters_leave_exact_members_out(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 2 + [" ".join([*base[:-1], f"x{i}"]) for i in range(3)]
    found = dedup.near_clusters(mentions(spark, texts)).collect()
    assert {r.mention_id for r in found} == {2, 3, 4} and all(r.cluster_size == 3 and r.cluster_id.startswith("near:") for r in found)


def test_spam_scores_and_reposts(spark):
    rows = mentions(spark, ["rt look at this now", "look at this now", "buy buy buy buy buy", "https://a.b https://c.d x"])
    got = {r.mention_id: r for r in spam.scored(dedup.annotated(rows, dedup.exact_members(rows))).collect()}
    assert got[0].mention_spam_score > got[1].mention_spam_score and "repost_like_behavior" in got[0].reasons
    assert "high_repetition_ratio" in got[2].reasons and "high_url_density" in got[3].reasons


def test_burstiness(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("close", base + dt.timedelta(minutes=10 * i)) for i in range(6)] + [("apart", base + dt.timedelta(hours=5 * i)) for i in range(6)] + [("one", base), ("edge", base), ("edge", base + dt.timedelta(minutes=60)), ("none", None)]
    got = {r.author: r.burstiness for r in windows.burstiness(spark.createDataFrame(rows, "author string, at timestamp"), "author", "at").collect()}
    assert got == {"close": 1.0, "apart": round(1 / 6, 4), "one": 0.0, "edge": 1.0}


def test_half_split_matches_sorting(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 40, 41):
        rows = [(i, dt.datetime(2024, 1, 1 + rng.randrange(5), rng.randrange(3))) for i in range(n)] + [(1000, None)]
        got = {r.id: r.half for r in windows.half_split(spark.createDataFrame(rows, "id long, at timestamp"), "at", "id").collect()}
        ordered = [i for _, i in sorted((t, i) for i, t in rows if t)]
        want = {i: ("previous" if k < n // 2 else "current") if n >= 2 else None for k, i in enumerate(ordered)} | {1000: None}
        assert got == want


def test_threads(spark):
    rows = [("p", None, "p", 0, None), ("c1", "p", "p", 1, 5), ("c2", "p", "p", 1, 9), ("r1", "c1", "p", 2, 1), ("r2", "r1", "p", 2, None), ("q", None, "q", 0, None)]
    frame = spark.createDataFrame([(*r, "a", "t") for r in rows], "origin_id string, parent_id string, root_id string, depth int, sort_score long, author_id string, text string")
    got = {r.root_id: r for r in threads.summaries(frame).collect()}
    assert (got["p"].total_mentions, got["p"].max_depth_observed, got["p"].comment_count, got["p"].reply_count) == (5, 2, 2, 2)
    assert got["p"].top_comment_ids == ["c2", "c1", "r1", "r2"] and got["q"].top_comment_ids == []
    paths = {r.id: r.lineage for r in threads.lineage(frame).collect()}
    assert paths["r2"] == ["p", "c1", "r1"] and paths["p"] == []
    kin = {r.id: (r.siblings, r.children) for r in threads.siblings(frame).collect()}
    assert kin["c1"] == (1, 1) and kin["p"] == (0, 2)
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "origin_id string, parent_id string")
    assert threads.lineage(cycle).count() == 2


@pytest.mark.parametrize(("counts", "tier"), [((0, 0, 0, 0), "nano"), ((15, 5, 0, 0), "micro"), ((80, 25, 0, 0), "mid"), ((300, 250, 0, 0), "macro"), ((None, None, None, 2000), "micro")])
def test_influence_tier(spark, counts, tier):
    assert value(spark, S.influence_tier(*[F.lit(c).cast("long") for c in counts])) == tier


@pytest.mark.parametrize(("label", "want"), [("en", "en"), ("__label__VI", "vi"), ("pt_BR", "pt"), ("jp", "ja"), ("in", "id"), ("", "unknown"), (None, "unknown"), ("zh-Hans", "zh"), ("english", "english")])
def test_language_labels(spark, label, want):
    assert value(spark, L.canonical(F.lit(label).cast("string"))) == want


def test_language_gate(spark):
    def gate(text):
        raw, compact = F.lit(text), T.compact(F.lit(text))
        return tuple(value(spark, L.gate(raw, compact, L.canonical(L.detected(raw, L.candidates(raw))["language"]))))

    assert gate("the battery is great and the price was good")[:2] == ("en", True)
    assert gate("sản phẩm này rất tốt và không đắt")[:2] == ("vi", True)
    assert gate("")[1:] == (False, "no_semantic_content")
    assert gate("これはペンです これはペンです")[:2] == ("unsupported", False)


def test_text_functions(spark):
    raw = "Xin chào @ban!!! #FlashSale2024 https://x.y/z đẹppppp ko"
    tags = T.hashtags(F.lit(raw))
    assert value(spark, tags) == ["flashsale2024"]
    assert value(spark, T.processing_text(F.lit("đẹppppp!!! ko #flash_sale"), T.hashtags(F.lit("#flash_sale")))) == "đẹpp! không flash sale"
    assert value(spark, T.template_key(F.lit("call 0912 #deal now"))) == "call <num> <tag> now"
    assert value(spark, T.nfkc(F.lit("ﬁ①"))) == unicodedata.normalize("NFKC", "ﬁ①")
    assert value(spark, T.snippet(F.lit("x" * 101))) == "x" * 100 + "..."
    assert value(spark, T.merged_content(F.lit("One."), F.lit("Two!!"), F.array(F.lit("three")))) == "One. Two. three"
    assert value(spark, T.clean_text(F.lit("  AE ơi #Deal http://x1.y2/z3 "))) == "anh em ơi deal"
    assert value(spark, T.repaired(F.lit("Ã©tÃ©"))) == "été" and value(spark, T.repaired(F.lit("été"))) == "été"
    assert value(spark, T.uuid5(envelopes.NAMESPACE, F.lit("p:1"))) == str(uuid.uuid5(uuid.UUID(envelopes.NAMESPACE), "p:1"))
    assert value(spark, T.segmented_tag(F.lit("bigSale2024_now"))) == "big Sale 2024 now"


def test_numbers(spark):
    assert value(spark, N.ratio(F.lit(1), F.lit(3))) == 0.3333 and value(spark, N.ratio(F.lit(1), F.lit(0))) == 0.0
    assert [value(spark, N.growth(F.lit(c), F.lit(p))) for c, p in ((0, 0), (5, 0), (6, 4))] == [0.0, 5.0, 0.5]
    assert value(spark, N.confidence(F.lit(2.0))) == 0.99


def test_crisis_levels(spark):
    def level(pressure, heat, falling):
        issues = spark.createDataFrame([(pressure,)], "issue_pressure_proxy double")
        hot = spark.createDataFrame([(heat,)], "controversy_score_proxy double")
        brands = spark.createDataFrame([(-1 if k < falling else 1,) for k in range(10)], "delta_mention_count int")
        return R.crisis(issues, hot, brands).first()["crisis_level"]

    assert [level(0.0, 0.0, 0), level(7.0, 0.0, 0), level(15.0, 0.7, 0), level(25.0, 0.0, 0)] == ["normal", "watch", "warning", "critical"]


def test_review_and_store(spark):
    facts = spark.createDataFrame([("a", "p", "entity", 0.65, 1), ("b", "p", "entity", 0.64, 2), ("c", "p", "keyword", 0.1, 3)], "item_id string, project_id string, fact_type string, confidence double, created_at int")
    assert [r.item_id for r in store.queued(facts).collect()] == ["b"] and store.queued(facts, force=True).count() == 2
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    changed = store.upserted(rows, spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string"), ["id"])
    assert sorted(map(tuple, changed.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert store.deleted(rows, {"v": "x"}).count() == 1 and store.deleted(rows, {"v": None}).count() == 0


def test_envelopes(spark):
    good = {"uap_version": "1.0", "ingest": {"project_id": "p"}, "content": {"doc_id": "d1", "doc_type": "comment", "text": "hi #A", "parent": {"parent_id": "d0"}, "published_at": "2024-01-01T00:00:00Z"}, "signals": {"engagement": {"like_count": 7, "view_count": "250"}}}
    flat = {"identity": {"uap_id": "u1", "project_id": "p", "uap_type": ""}, "engagement": {"likes": "2.5", "shares": 3}, "media": [{"type": "image", "url": "", "download_url": "d"}]}
    bad = [{"uap_version": "2.0", "ingest": {"project_id": "p"}, "content": {"doc_id": "d"}}, {"identity": {"uap_id": "u"}}, {"x": 1}, "broken"]
    messages = spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in (good, flat, *bad)], "value string")
    rows = envelopes.parsed(messages)
    found = {r.doc_id: r for r in envelopes.accepted(rows).collect()}
    assert (found["d1"].likes, found["d1"].views, found["u1"].likes, found["u1"].shares, found["u1"].doc_type) == (7, 250, 0, 3, "post")
    assert found["u1"].attachments[0].url == "d" and found["d1"].posted_at is not None
    assert {r.reject_reason: r.n for r in envelopes.rejected(rows).collect()} == {"unsupported_version": 1, "missing_project_id": 1, "unknown_format": 2}
    silver = {r.origin_id: r for r in envelopes.mentions(envelopes.accepted(rows)).collect()}
    assert (silver["d1"].depth, silver["d1"].root_id, silver["d1"].sort_score, silver["u1"].views) == (1, "d0", 9, None)


def test_entities_and_semantics(spark):
    index = entities.alias_index(spark.createDataFrame([("e1", "Big Brand", ["BB"], 0), ("e2", "bb", [], 1)], "entity_id string, name string, aliases array<string>, ord int"))
    assert {r.alias: r.entity_id for r in index.collect()} == {"big brand": "e1", "bb": "e2"}
    rows = spark.createDataFrame([(1, "I like the big brand, really"), (2, "bbq is no brand"), (3, "")], "mention_id long, text string")
    assert [tuple(r) for r in entities.text_scan(rows, index).collect()] == [(1, "e1")]
    pick = lambda t: semantics.label(semantics.polarity(F.lit(t)))
    assert [value(spark, pick(t)) for t in ("a good day", "not good", "trash", "plain")] == ["positive", "negative", "negative", "neutral"]
    assert [s.text for s in value(spark, semantics.segments(F.lit("good, but bad. end")))] == ["good", "bad", "end"]
    facts = spark.createDataFrame([("r", "c", i, t) for i, t in enumerate(["one two three", "one two three four", "nine ten"])], "root_id string, category string, mention_id long, text string")
    assert {r.mention_id: r.corroborating for r in semantics.corroboration(facts).collect()} == {0: 2, 1: 2, 2: 1}
    assert {r.mention_id: r.corroborating for r in semantics.corroboration(facts, most=2).collect()} == {0: 1, 1: 1, 2: 1}


def test_files_and_dictionaries(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"doc_id": "1"}, {"doc_id": "2"}]')
    (tmp_path / "b.json").write_text('{"items": [{"doc_id": "3"}]}')
    (tmp_path / "c.json").write_text('{"doc_id": "4"}')
    got = files.json_batch(spark, f"{tmp_path}/*.json", "struct<doc_id:string>")
    assert sorted(r.doc_id for r in got.collect()) == ["1", "2", "3", "4"]
    files.write_bundle({"t": got, "empty": got.limit(0)}, f"{tmp_path}/bundle")
    files.register(spark, f"{tmp_path}/bundle", ["t", "empty"])
    assert spark.sql("SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM empty)").first()[0] == 4
    (tmp_path / "d.yaml").write_text("domain_code: cars\naspects: {}\n")
    (tmp_path / "e.yaml").write_text("a: [")
    configs = dictionaries.domains(str(tmp_path))
    assert dictionaries.domain_of(configs, "cars")["domain_code"] == "cars" and dictionaries.domain_of(configs, "none")["domain_code"] == "_default"
    with pytest.raises(ValueError, match="nothing"):
        dictionaries.ontology(spark, {"taxonomy": [{"id": "a", "parent_id": "b"}]})
    assert dictionaries.term_map({"x": {"primary": ["A"]}, "y": {"secondary": ["a"]}}) == {"a": "y"}


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = E.file_stream(spark, f"{tmp_path}/in", source.schema, "*.parquet")
    E.run_batches(stream, lambda frame, _: seen.extend(r.event_id for r in frame.select("event_id").collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted(seen) == sorted(r.event_id for r in source.select("event_id").collect())
    assert E.publish_in_order([("a", lambda: None), ("b", lambda: None)]) == ["a", "b"]


def test_nlp_rules_and_plug_in_scorer(spark):
    assert tuple(value(spark, nlp.intent(F.lit("Bán sim, thất vọng")))) == ("SPAM", 0.6, True)
    assert tuple(value(spark, nlp.intent(F.lit("hello")))) == ("DISCUSSION", 1.0, False)
    around = lambda t, k, r=100: value(spark, nlp.context(F.lit(t), F.lit(k), r))
    assert around("It was late. The battery is great, but pricey", "battery") == "The battery is great"
    assert around("no such word here", "battery") == "no such word here"
    assert around("aaa bbbbbb battery cccccc ddd", "battery", 4) == "bbbbbb battery cccccc"
    nlp.register_scorer("model", nlp.batch_scorer(lambda: lambda texts: [("POS" if "good" in t else "NEG", 0.9) for t in texts]))
    rows = spark.createDataFrame([(1, "good"), (2, "else"), (3, None)], "mention_id long, text string")
    assert {r.mention_id: (r.sentiment, r.score) for r in nlp.sentiment(rows, "model").collect()} == {1: ("POS", 0.5), 2: ("NEG", -0.5), 3: ("NEU", 0.0)}
    assert tuple(value(spark, nlp.model_score(F.lit("POSITIVE")))) == (0.5, 4)


def test_payload_maps(spark):
    assert value(spark, P.platform(F.lit("TikTok"))) == "TIKTOK" and value(spark, P.platform(F.lit("x"))) == "OTHER"
    assert value(spark, P.signed(F.lit("NEGATIVE"), F.lit(0.4))) == -0.4 and value(spark, P.priority(F.lit(0.5))) == "MEDIUM"
    assert value(spark, P.media_type(F.array(F.struct(F.lit("Photo").alias("type"))))) == "image"


def test_batch_pipeline(spark):
    def message(i, text, parent=None, kind="post"):
        return json.dumps({"uap_version": "1.0", "ingest": {"project_id": "p", "source": {"source_type": "Facebook"}}, "content": {
            "doc_id": f"d{i}", "doc_type": kind, "text": text, "published_at": f"2024-01-{1 + i % 28:02d}T00:00:00Z", "author": {"author_id": f"a{i % 3}"}, "parent": {"parent_id": parent}},
            "signals": {"engagement": {"like_count": i}}})

    rows = [message(i, f"The Acme phone is {'good' if i % 2 else 'trash and stupid'} and the price of it was number {i}") for i in range(12)]
    rows += [message(20, "What is this about the Acme trash?", "d0", "comment"), message(21, "It is the same for me and for you", "d20", "reply"), message(22, "?"), "junk"]
    ontology = spark.createDataFrame([("e:acme", "Acme", ["The Acme"], 0)], "entity_id string, name string, aliases array<string>, ord int")
    out = run_batch(spark.createDataFrame([(r,) for r in rows], "value string"), ontology)
    assert {r.reject_reason for r in out["rejected"].collect()} == {"unknown_format"}
    assert out["fact_mentions"].count() == 14
    sov = out["sov_report"].collect()
    assert sov[0].entity_id == "e:acme" and sov[0].mention_count >= 12
    assert {r.issue_category for r in out["top_issues_report"].collect()} == {"insult", "disgust"}
    found = {r.root_id: r.total_mentions for r in out["fact_threads"].collect()}
    assert found["d0"] == 2 and out["crisis"].count() == 1 and out["insight_cards"].count() >= 2
    few = run_batch(spark.createDataFrame([(r,) for r in rows], "value string"), options=Options(off=frozenset({"dedup", "spam", "enrichment"})))
    assert "sov_report" not in few and few["fact_mentions"].count() == 14


def test_lineage_of_long_threads_and_cycles(spark):
    rows = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(50)] + [("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("self", "self"), ("lost", "nowhere")]
    paths = {r.id: r.lineage for r in threads.lineage(spark.createDataFrame(rows, "origin_id string, parent_id string")).collect()}
    assert all(paths[f"m{i}"] == [f"m{k}" for k in range(i)] for i in range(50))
    assert paths["a"] == ["c", "b"] and paths["tail"] == ["c", "b", "a"] and paths["self"] == [] and paths["lost"] == []


def test_frequent_tokens_link_topics(spark):
    rng = random.Random(6)
    held = {i: {"often", *(f"w{rng.randrange(150)}" for _ in range(2)), *(["usual"] if i % 2 else [])} for i in range(60)}
    tops = spark.createDataFrame([(i, t, 1) for i, s in held.items() for t in s], "mention_id long, token string, n long")
    up = {i: i for i in held}
    for a in held:
        for b in held:
            if a < b and len(held[a] & held[b]) >= 2:
                up = {k: min(up[a], up[b]) if v in (up[a], up[b]) else v for k, v in up.items()}
    sizes = sorted(n for r in set(up.values()) if (n := list(up.values()).count(r)) > 1)
    assert sorted(r.mentions for r in topics.clusters(tops).collect()) == sizes and sizes[-1] >= 30


def test_sharing_pairs_meet_once_and_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    held = {i: {"often", *(["usual"] if i % 3 else []), *(f"w{rng.randrange(12)}" for _ in range(rng.randrange(7)))} for i in range(90)}
    tops = spark.createDataFrame([(i, t, 1) for i, s in held.items() for t in s], "mention_id long, token string, n long")
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 2}
    for block in (4096, 8):
        monkeypatch.setattr(topics, "BLOCK", block)
        pairs = topics.sharing_pairs(tops)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # The plan's top is the join: no exchange or sum stands above it.
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_near_pairs_store_little(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"u{i}x{k}" for k in range(60)) for i in range(40)]
    texts += [" ".join(w if rng.random() > 0.02 else "zz" for w in texts[0].split()) + f" v{j}" for j in range(5)] + [texts[1]] * 3
    stored = []
    write = dedup.Stored.write
    monkeypatch.setattr(dedup.Stored, "write", lambda self, frame: stored.append(out := write(self, frame)) or out)
    rows = mentions(spark, texts)
    got = {(r.a, r.b) for r in dedup.near_pairs(rows, without=dedup.copied(rows)).collect()}
    copies = {i for i, t in enumerate(texts) if texts.count(t) > 1}
    assert got == {(a, b) for a, b in brute_pairs(texts) if not {a, b} & copies} and len(got) >= 3
    # Sets that share nothing leave no rows, and only those in pairs are read in full.
    assert len({x for p in got for x in p}) <= stored[-1].count() < 8


def test_compact_is_the_squeezed_text_without_other_signs(spark):
    found = spark.createDataFrame([(" A_b/c\u00a0--d: #E+\t\nf!? ",), ("!!",), (None,)], "t string").select(T.compact(F.col("t")).alias("v"))
    assert [r.v for r in found.collect()] == ["a b c --d: #e+ f", "", None]
