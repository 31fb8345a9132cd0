"""Scores of mentions, authors, engagement, impact and risk as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp

# Weights, thresholds and words that results depend on.
SPAM_WEIGHTS = {"high_url_density": 0.22, "low_lexical_diversity": 0.22, "high_repetition_ratio": 0.20, "duplicate_cluster_participation": 0.22, "repost_like_behavior": 0.14}
PLATFORM_WEIGHT = {"TIKTOK": 1.0, "FACEBOOK": 1.2, "YOUTUBE": 1.5, "INSTAGRAM": 1.1}
SENTIMENT_WEIGHT = {"NEGATIVE": 1.5, "NEUTRAL": 1.0, "POSITIVE": 1.1}
SEVERITY_WEIGHT = {"low": 0.6, "medium": 1.0, "high": 1.45, "critical_like_proxy": 1.8}
EVIDENCE_WEIGHT = {"direct_complaint": 1.0, "direct_observation": 0.95, "comparison_based_critique": 0.8, "question_or_uncertainty": 0.55, "hearsay_or_rumor": 0.45, "escalation_signal": 1.15}
CRISIS_WORDS = ["scam", "lừa đảo", "lừa", "gian lận", "cháy", "nổ", "tai nạn", "chết", "tẩy chay", "phốt", "scandal", "nguy hiểm", "độc hại", "kém chất lượng"]
STANCE_WORDS = {"question": (["hỏi", "sao", "why", "what"], 0.8), "oppose": (["không", "lỗi", "bad", "hate", "chậm"], 0.65), "support": (["đẹp", "tốt", "love", "good", "tự hào"], 0.65)}
INTENT_WORDS = {
    "question": (["hỏi"], 0.85), "purchase_intent": (["mua", "đặt", "giá", "buy"], 0.7), "praise": (["đẹp", "tốt", "love", "chúc mừng"], 0.7),
    "complaint": (["lỗi", "chậm", "bad", "không"], 0.65), "compare": (["so với", "compare", "hơn"], 0.6),
}


def looked_up(key: Column, table: dict[str, float], default: float) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(default)


def any_of(text: Column, listed: list[str]) -> Column:
    return reduce(lambda a, w: a | text.contains(w), listed, F.lit(False))


def spam_parts(tokens: Column, n_urls: Column, cluster_size: Column, repost: Column) -> dict[str, Column]:
    """The five components of a mention's spam score, each between 0 and 1."""
    n = F.size(tokens)
    kinds = F.array_distinct(tokens)
    diversity = F.when(n > 0, F.size(kinds) / n).otherwise(1.0)
    # Largest count of one token, from runs in the sorted tokens: linear, where counting each kind would be quadratic.
    state = F.named_struct(F.lit("was"), F.lit(None).cast("string"), F.lit("run"), F.lit(0), F.lit("most"), F.lit(0))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["was"] == t, s["run"] + 1).otherwise(1)
        return F.named_struct(F.lit("was"), t, F.lit("run"), run, F.lit("most"), F.greatest(s["most"], run))

    most = F.aggregate(F.array_sort(tokens), state, step, lambda s: s["most"])
    share = F.when(n > 0, most / n).otherwise(0.0)
    return {
        "high_url_density": F.least(n_urls / F.greatest(n, F.lit(1)) * 2.5, F.lit(1.0)),
        "low_lexical_diversity": F.when(n >= 4, F.greatest(F.lit(0.0), 0.45 - diversity) / 0.45).otherwise(0.0),
        "high_repetition_ratio": F.when(n > 0, F.greatest(1 - diversity, share)).otherwise(0.0),
        "duplicate_cluster_participation": F.greatest(cluster_size - 1, F.lit(0)) / F.greatest(cluster_size, F.lit(1)),
        "repost_like_behavior": F.when(repost, 1.0).otherwise(0.0),
    }


def spam_score(parts: dict[str, Column]) -> Column:
    return F.round(F.least(sum(parts[k] * w for k, w in SPAM_WEIGHTS.items()), F.lit(1.0)), 4)


def quality_weight(dedup_weight: Column, mention_score: Column, author_score: Column) -> Column:
    return F.round(dedup_weight * F.greatest(1 - mention_score * 0.65, F.lit(0.15)) * F.greatest(1 - author_score * 0.45, F.lit(0.15)), 6)


def engagement(likes: Column, comments: Column, shares: Column, views: Column) -> Column:
    raw = likes + 2 * comments + 3 * shares
    return F.least(F.when(views >= 100, raw / views * 100).otherwise(raw.cast("double")), F.lit(100.0))


def virality(likes: Column, comments: Column, shares: Column) -> Column:
    return shares / (likes + comments + 1)


def reach(followers: Column, verified: Column) -> Column:
    return F.log10(followers + 1) * F.when(verified, 1.2).otherwise(1.0)


def impact(engaged: Column, reached: Column, platform: Column, sentiment: Column) -> Column:
    """0 to 100: engagement by reach by platform by sentiment, saturating at 100 000."""
    raw = engaged * reached * looked_up(F.upper(platform), PLATFORM_WEIGHT, 1.0) * looked_up(F.upper(sentiment), SENTIMENT_WEIGHT, 1.0)
    return clamp(raw / 100000.0 * 100, 0.0, 100.0)


def risk(sentiment_score: Column, text: Column, viral: Column) -> Column:
    """Additive risk, amplified by virality."""
    base = F.when(sentiment_score < -0.3, 0.3).otherwise(0.0) + F.when(sentiment_score < -0.7, 0.2).otherwise(0.0) + F.when(any_of(F.lower(text), CRISIS_WORDS), 0.4).otherwise(0.0)
    return F.when((base >= 0.3) & (viral > 0.1), base * (1 + viral)).otherwise(base)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def influence_tier(likes: Column, comments: Column, shares: Column, views: Column) -> Column:
    score = F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0)) + F.coalesce(shares, F.lit(0)) + F.coalesce(views, F.lit(0)) / 100.0
    return F.when(score >= 500, "macro").when(score >= 100, "mid").when(score >= 20, "micro").otherwise("nano")


def by_rules(raw: Column, normalized: Column, rules: dict, fallback: tuple[str, float], label: str) -> Column:
    """struct(label, confidence) of the first rule that holds; a question mark is the first rule's."""
    out, first = None, True
    for name, (listed, conf) in rules.items():
        holds = any_of(normalized, listed)
        holds = (raw.contains("?") | holds) if first else holds
        case = F.struct(F.lit(name).alias(label), F.lit(conf).alias("confidence"))
        out = F.when(holds, case) if first else out.when(holds, case)
        first = False
    return out.otherwise(F.struct(F.lit(fallback[0]).alias(label), F.lit(fallback[1]).alias("confidence")))


def stance(raw: Column, normalized: Column) -> Column:
    return by_rules(raw, normalized, STANCE_WORDS, ("neutral", 0.45), "stance")


def intent(raw: Column, normalized: Column) -> Column:
    return by_rules(raw, normalized, INTENT_WORDS, ("commentary", 0.4), "intent")


def issue_pressure(severity: Column, evidence: Column, conf: Column, grounding: Column, corroboration: Column) -> Column:
    """One fact's pressure; grounding that is missing or 0 counts 0.55, corroboration 0.5."""
    floor = lambda c, default: F.greatest(F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default)), F.lit(0.35))
    trust = (F.greatest(F.coalesce(conf, F.lit(0.0)), F.lit(0.25)) + floor(grounding, 0.55) + floor(corroboration, 0.5)) / 3
    return looked_up(severity, SEVERITY_WEIGHT, 1.0) * looked_up(evidence, EVIDENCE_WEIGHT, 0.7) * (0.35 + 0.65 * trust)
