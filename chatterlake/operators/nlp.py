"""Rule-based intent, keywords and aspect sentiment, with model scorers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Intents with their priorities, and patterns that speak for each (ignoring letter case).
PRIORITY = {"CRISIS": 10, "SEEDING": 9, "SPAM": 9, "COMPLAINT": 7, "LEAD": 5, "SUPPORT": 4, "DISCUSSION": 1}
PATTERNS = {
    "CRISIS": [r"tẩy\s*chay", r"lừa\s*đảo", r"lừa.*đảo", r"scam", r"phốt", r"bóc\s*phốt", r"bóc.*phốt", r"lừa\s*gạt", r"gian\s*lận", r"cảnh\s*báo"],
    "SEEDING": [r"\b0\d{9,10}\b", r"zalo.*\d{9,10}", r"inbox.*giá", r"inbox.*mua", r"liên\s*hệ.*mua", r"liên\s*hệ.*\d{9}", r"inbox.*shop", r"chat.*shop"],
    "SPAM": [r"vay\s*tiền", r"vay\s*vốn", r"bán\s*sim", r"lãi\s*suất", r"giải\s*ngân", r"tuyển\s*dụng", r"cần\s*gấp", r"thu\s*nhập"],
    "COMPLAINT": [r"lỗi.*(không|chưa).*sửa", r"lỗi.*chưa.*khắc\s*phục", r"thất\s*vọng", r"tệ\s*quá", r"tệ.*nhất", r"đừng.*mua", r"không.*nên.*mua", r"rác.*quá", r"(tồi|tệ|kém).*chất\s*lượng", r"chất\s*lượng.*(tệ|kém)"],
    "LEAD": [r"giá.*bao\s*nhiêu", r"bao\s*nhiêu.*tiền", r"mua.*ở\s*đâu", r"ở\s*đâu.*mua", r"test\s*drive", r"xin.*giá", r"cho.*xin.*giá", r"đặt.*mua", r"đặt.*cọc", r"mua.*ngay"],
    "SUPPORT": [r"cách.*sạc", r"làm\s*sao.*sạc", r"showroom", r"đại\s*lý", r"bảo\s*hành", r"sửa\s*chữa", r"hướng\s*dẫn", r"cách.*sử\s*dụng", r"trung\s*tâm.*bảo\s*hành"],
}
#: What ends a context around a keyword.
DELIMITERS = r"(?:[.,;!?]|nhưng|tuy nhiên|mặc dù|bù lại)"
MODEL_SCORES = {"NEG": (-0.5, 2), "POS": (0.5, 4), "NEU": (0.0, 3)}


def intent(text: Column, patterns: dict[str, list[str]] | None = None, priority: dict[str, int] | None = None) -> Column:
    """struct(intent, confidence, skip): the matching intent of the highest priority; the first listed on a tie."""
    patterns, priority = patterns or PATTERNS, priority or PRIORITY
    found = []
    for k, (name, listed) in enumerate(patterns.items()):
        hits = sum((text.rlike(f"(?iu){p}").cast("int") for p in listed), F.lit(0))
        found.append(F.when(hits > 0, F.struct(F.lit(-priority[name]).alias("order"), F.lit(k).alias("nth"), F.lit(name).alias("intent"), F.least(0.5 + 0.1 * hits, F.lit(1.0)).alias("confidence"))))
    none = F.struct(F.lit(0).alias("order"), F.lit(99).alias("nth"), F.lit("DISCUSSION").alias("intent"), F.lit(1.0).alias("confidence"))
    best = lambda x: F.struct(x["intent"].alias("intent"), F.round(x["confidence"], 4).alias("confidence"), x["intent"].isin("SPAM", "SEEDING").alias("skip"))
    return T.let(F.array_min(F.array_append(F.array_compact(F.array(*found)), none)), best)


def context(text: Column, keyword: Column, radius: int = 100) -> Column:
    """The text around a keyword's first place: at most `radius` characters each way, cut at the nearest delimiter,
    stretched to whole words; the whole text if the keyword isn't in it."""
    at = F.locate(keyword, F.lower(text)) if isinstance(keyword, str) else F.position(F.lower(keyword), F.lower(text))

    def around(x: Column) -> Column:
        t, k, p = x["t"], x["k"], x["p"]
        low, high = F.greatest(p - radius, F.lit(1)), p + F.length(k)
        left, right = F.substring(t, low, p - low), F.substring(t, high, F.lit(radius))
        kept = F.regexp_extract(left, rf"(?s)((?:(?!{DELIMITERS}).)*)$", 1)
        kept_right = F.get(F.split(right, DELIMITERS, 2), 0)
        start, end = p - F.length(kept), high + F.length(kept_right)
        word_before = F.when(F.substring(t, start, F.lit(1)).rlike(r"^\S"), F.regexp_extract(F.substring(t, F.lit(1), start - 1), r"(\S*)$", 1)).otherwise("")
        word_after = F.regexp_extract(F.substring(t, end, F.length(t)), r"^(\S*)", 1)
        out = F.concat(word_before, F.substring(t, start, end - start), word_after)
        out = F.regexp_replace(out, r"^[ \n\t.,;!?]+|[ \n\t.,;!?]+$", "")
        return F.when((p == 0) | (F.length(out) < F.length(k)), t).otherwise(out)

    return T.let(F.struct(text.alias("t"), keyword.alias("k"), at.alias("p")), around)


def dictionary_keywords(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """mention_id, term, aspect of every dictionary term (term, aspect, at most four words) whose words stand in the text."""
    from .entities import text_scan

    index = terms.select(F.col("term").alias("alias"), F.concat_ws("\t", "aspect", "term").alias("entity_id"))
    found = text_scan(texts, index)
    return found.select("mention_id", F.substring_index("entity_id", "\t", -1).alias("term"), F.substring_index("entity_id", "\t", 1).alias("aspect"))


def keyword_confidence(keywords: DataFrame) -> DataFrame:
    """mention_id and confidence of extracted keywords (mention_id, type, score, entity_type): count, kinds, entities and spread."""
    part = keywords.groupBy("mention_id").agg(
        F.least(F.count("*") / 30, F.lit(1.0)).alias("a"), F.least(F.count_distinct("type") / 4, F.lit(0.2)).alias("b"),
        F.least(F.count_distinct("entity_type") / 5, F.lit(0.15)).alias("c"), F.least(F.var_pop("score"), F.lit(0.15)).alias("d"))
    return part.select("mention_id", F.round(F.least(F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.lit(1.0)), 6).alias("confidence"))


def aspect_sentiment(scored: DataFrame) -> DataFrame:
    """Per mention and aspect: the confidence-weighted mean score, mean confidence, rounded rating and label.

    scored: mention_id, aspect, score, confidence, rating.
    """
    weight = F.sum("confidence")
    score = F.round(F.when(weight > 0, F.sum(F.col("score") * F.col("confidence")) / weight).otherwise(0.0), 4)
    rows = scored.groupBy("mention_id", "aspect").agg(score.alias("score"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("rating")).cast("int").alias("rating"), F.count("*").alias("mentions"))
    return rows.withColumn("label", F.when(F.col("score") > 0.25, "POSITIVE").when(F.col("score") < -0.25, "NEGATIVE").otherwise("NEUTRAL"))


def model_score(label: Column) -> Column:
    """struct(score, rating) of a model's class."""
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("score"), F.lit(3).alias("rating")))
    for name, (score, rating) in MODEL_SCORES.items():
        out = out.when(F.upper(label).startswith(name), F.struct(F.lit(score).alias("score"), F.lit(rating).alias("rating")))
    return out.otherwise(F.struct(F.lit(0.0).alias("score"), F.lit(3).alias("rating")))


Scorer = Callable[[DataFrame], DataFrame]
_scorers: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """A scorer takes mentions (mention_id, text) and returns mention_id, sentiment, score, confidence."""
    _scorers[name] = scorer


def sentiment(mentions: DataFrame, scorer: str = "lexicon") -> DataFrame:
    from .semantics import mention_sentiment

    return _scorers.get(scorer, mention_sentiment)(mentions)


def batch_scorer(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Scorer:
    """A scorer around a model: load() once a task, then lists of texts in, (class, confidence) out; empty texts are neutral."""
    def score(mentions: DataFrame) -> DataFrame:
        kind = mentions.schema["mention_id"].dataType.simpleString()

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                texts = batch["text"].fillna("").tolist()
                full = [k for k, t in enumerate(texts) if t.strip()]
                found = [("NEU", 1.0)] * len(texts)
                for k, out in zip(full, model([texts[k] for k in full]) if full else [], strict=True):
                    found[k] = out
                yield pd.DataFrame({"mention_id": batch["mention_id"], "sentiment": [c for c, _ in found], "score": [MODEL_SCORES.get(c[:3].upper(), (0.0, 3))[0] for c, _ in found], "confidence": [p for _, p in found]})

        return mentions.select("mention_id", "text").mapInPandas(rows, f"mention_id {kind}, sentiment string, score double, confidence double")

    return score
