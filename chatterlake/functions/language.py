"""Language heuristics: script shares, hint words, mixed texts, and the gate before analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Unicode blocks of the scripts that tell a language, and Vietnamese letters.
SCRIPTS = {
    "ja": r"[\x{3040}-\x{30FF}]", "zh": r"[\x{4E00}-\x{9FFF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ru": r"[\x{0400}-\x{04FF}]",
    "ar": r"[\x{0600}-\x{06FF}]", "hi": r"[\x{0900}-\x{097F}]", "th": r"[\x{0E00}-\x{0E7F}]",
}
UNSUPPORTED_SCRIPT = r"[\x{0900}-\x{097F}\x{0E00}-\x{0E7F}\x{0980}-\x{09FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
VIETNAMESE = "ăâđêôơưàáạảãầấậẩẫằắặẳẵèéẹẻẽềếệểễìíịỉĩòóọỏõồốộổỗờớợởỡùúụủũừứựửữỳýỵỷỹ"


@dataclass(frozen=True)
class Hints:
    """Words that speak for a language. Configuration: these are small samples."""

    vi: tuple[str, ...] = ("không", "được", "của", "và", "là", "có", "cho", "này", "với", "mình", "rất", "nhưng")
    en: tuple[str, ...] = ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "it", "are", "this", "on", "be", "by", "as", "at", "from", "or")
    id: tuple[str, ...] = ("yang", "dan", "untuk", "tidak", "dengan", "ini", "itu", "dari")
    names: tuple[str, ...] = ("vf",)
    short: tuple[str, ...] = ("delivery", "battery", "charging", "launch", "support")
    others: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "fr": ("le", "la", "les", "des", "et", "que", "est", "une", "dans", "pour"), "de": ("der", "die", "und", "ist", "nicht", "das", "ein", "mit", "zu", "von"),
        "es": ("el", "los", "que", "de", "una", "por", "con", "para", "las", "en")})


def canonical(label: Column) -> Column:
    """A language label as its primary subtag; unknown for none."""
    clean = F.regexp_replace(F.lower(F.trim(label)), "^__label__", "")
    clean = F.replace(clean, F.lit("_"), F.lit("-"))
    primary = F.substring_index(clean, "-", 1)
    known = F.when(primary == "jp", "ja").when(primary == "in", "id").when(primary.rlike("^[a-z]{2,3}$"), primary)
    return F.coalesce(known, F.nullif(clean, F.lit("")), F.lit("unknown"))


def script_shares(text: Column) -> Column:
    """Share of each script among the characters of all of them."""
    counts = F.array(*[F.struct(F.lit(k).alias("lang"), F.regexp_count(text, F.lit(p)).alias("n")) for k, p in SCRIPTS.items()])
    found = F.filter(counts, lambda x: x["n"] > 0)
    total = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
    return F.transform(found, lambda x: F.struct(x["lang"].alias("lang"), F.round(x["n"] / total, 4).alias("share")))


def hits(tokens: Column, hints: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*hints)))


def candidates(text: Column, hints: Hints = Hints()) -> Column:
    """Languages with their scores, best first; empty if nothing speaks for any."""
    tokens = F.transform(T.words(text), F.lower)
    n = F.greatest(F.size(tokens), F.lit(1))
    shares = script_shares(text)
    foreign = text.rlike(r"[^\x00-\x7F]")
    vietnamese = F.lower(text).rlike(f"[{VIETNAMESE}]")
    out = []
    for lang, listed in {"vi": hints.vi, "en": hints.en, "id": hints.id, **hints.others}.items():
        found = hits(tokens, listed)
        bonus = F.when(foreign, 0.12).otherwise(0.0) if lang == "vi" else F.lit(0.0)
        score = F.when(found > 0, F.round(F.least(found / n + bonus, F.lit(0.96)), 4)).otherwise(0.0)
        if lang == "vi":
            score = F.when(vietnamese, F.greatest(score, F.lit(0.52))).otherwise(score)
        out.append(F.struct(F.lit(lang).alias("lang"), score.alias("score")))
    scripts = F.transform(shares, lambda x: F.struct(x["lang"].alias("lang"), F.round(F.least(0.55 + x["share"] * 0.4, F.lit(0.98)), 4).alias("score")))
    ranked = F.filter(F.concat(F.array(*out), scripts), lambda x: x["score"] > 0)
    return F.transform(F.array_sort(F.transform(ranked, lambda x: F.struct((-x["score"]).alias("minus"), x["lang"].alias("lang")))), lambda x: F.struct(x["lang"].alias("lang"), (-x["minus"]).alias("score")))


def detected(text: Column, ranked: Column) -> Column:
    """struct(language, confidence): the best candidate, mixed if two are close, unknown if there is none."""
    return T.let(F.struct(text.alias("text"), ranked.alias("ranked"), script_shares(text).alias("shares")), lambda x: _detected(x["ranked"], x["shares"]))


def _detected(ranked: Column, shares: Column) -> Column:
    top, second = ranked[0], F.get(ranked, 1)
    gap = top["score"] - second["score"]
    pair = F.array_sort(F.array(top["lang"], second["lang"])) == F.array(F.lit("en"), F.lit("vi"))
    several = (F.size(shares) >= 2) & (F.array_max(F.transform(shares, lambda x: x["share"])) < 0.88)
    close = (F.size(ranked) >= 2) & (((second["score"] >= 0.55 * 0.45) & (gap <= 0.12)) | (pair & (second["score"] >= 0.22) & (gap <= 0.24)))
    mixed = F.struct(F.lit("mixed").alias("language"), F.round(F.greatest((top["score"] + F.coalesce(second["score"], top["score"])) / 2, F.lit(0.55)), 4).alias("confidence"))
    none = F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))
    single = F.struct(top["lang"].alias("language"), top["score"].alias("confidence"))
    return F.when(F.size(ranked) == 0, none).when(F.coalesce(close, F.lit(False)) | several, mixed).otherwise(single)


def gate(raw: Column, compact: Column, provider: Column, hints: Hints = Hints()) -> Column:
    """struct(language, supported, reason): which texts go on to analysis. provider: canonical label found before."""
    held = F.struct(raw.alias("raw"), T.words(compact).alias("tokens"), provider.alias("provider"))
    return T.let(held, lambda x: _gate(x["raw"], x["tokens"], x["provider"], hints))


def _gate(raw: Column, tokens: Column, provider: Column, hints: Hints) -> Column:
    n = F.greatest(F.size(tokens), F.lit(1))
    digit = lambda t: t.rlike(r"\p{N}")
    entity_like = F.size(F.filter(tokens, lambda t: digit(t) | t.isin(*hints.names) | (t.rlike("^[A-Za-z]{1,3}$") & ~t.isin(*hints.en, *hints.id))))
    semantic = F.filter(tokens, lambda t: ~t.isin(*hints.names) & (F.length(t) >= 2) & t.rlike(r"^\p{L}+$"))
    count = F.size(semantic)
    vi_words = F.size(F.filter(semantic, lambda t: t.isin(*hints.vi) | t.rlike(f"[{VIETNAMESE}]")))
    en_words = hits(semantic, hints.en)
    ascii_words = F.size(F.filter(semantic, lambda t: t.rlike(r"^[\x00-\x7F]{4,}$") & ~t.isin(*hints.id)))
    marked = F.lower(raw).rlike(f"[{VIETNAMESE}]")
    add = lambda *cases: sum((F.when(c, v).otherwise(0.0) for c, v in cases), F.lit(0.0))
    vi = hits(tokens, hints.vi) / n + add((marked, 0.28), (provider == "vi", 0.18), (provider == "mixed", 0.08))
    en = hits(tokens, hints.en) / n + add((provider == "en", 0.16), (provider == "mixed", 0.08))
    indonesian = hits(tokens, hints.id) / n + add((provider == "id", 0.18))
    letters = F.regexp_count(raw, F.lit(r"\p{L}"))
    bad = indonesian + F.when(letters > 0, F.regexp_count(raw, F.lit(UNSUPPORTED_SCRIPT)) / letters).otherwise(0.0)
    result = lambda language, supported, reason: F.struct(F.lit(language).alias("language"), F.lit(supported).alias("supported"), (reason if isinstance(reason, Column) else F.lit(reason).cast("string")).alias("reason"))
    open_provider = provider.isin("en", "mixed", "unknown")
    return (
        F.when(F.size(tokens) == 0, result("unsupported", False, "no_semantic_content"))
        .when((bad >= 0.42) & (bad > vi + en + 0.08), result("unsupported", False, "unsupported_language"))
        .when(count == 0, result("unsupported", False, F.when(entity_like > 0, "non_vi_en_latin_noise").otherwise("no_semantic_content")))
        .when(((vi >= 0.18) | (vi_words >= 2) | marked) & ((en >= 0.12) | (en_words >= 1)) & (count >= 2) & (bad < 0.24), result("mixed", True, None))
        .when((vi_words >= 1) & (ascii_words >= 2) & (count >= 4) & open_provider & (bad < 0.18), result("mixed", True, None))
        .when((vi >= 0.2) | (vi_words >= 2), result("vi", True, None))
        .when((((en >= 0.2) & (count >= 2)) | ((count == 1) & F.get(semantic, 0).isin(*hints.short) & open_provider)) & (bad < 0.18), result("en", True, None))
        .when((entity_like / n >= 0.5) & (vi + en < 0.18), result("unsupported", False, "non_vi_en_latin_noise"))
        .when((vi + en < 0.18) & (count <= 2), result("unsupported", False, "low_vi_en_evidence"))
        .when((ascii_words >= 3) & (vi < 0.14) & (indonesian < 0.10) & (bad < 0.15) & ~provider.isin("vi", "id") & (count >= 3), result("en", True, None))
        .otherwise(result("unsupported", False, "unsupported_language"))
    )
