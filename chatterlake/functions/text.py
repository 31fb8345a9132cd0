"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results depend on.
URL = r"https?://\S+"
HANDLE = r"@[\p{L}\p{N}_.]+"
HASHTAG = r"#([\p{L}\p{N}_-]+)"
EMOJI = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}]+"
CLEAN_URL = r"(?:https?://|www\.)[A-Za-z0-9$-_@.&+!*\\(),%]+"
CLEAN_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
PHONE = r"(03|05|07|08|09|01[2689])\d{8}"
SLANG = {"ko": "không", "k": "không", "hok": "không", "dc": "được", "đc": "được", "vs": "với", "sp": "sản phẩm", "nv": "nhân viên"}
TEENCODE = {
    "ko": "không", "k": "không", "khg": "không", "hk": "không", "vkl": "rất", "vcl": "rất", "ae": "anh em", "tml": "thì", "thì ml": "thì",
    "dc": "được", "đc": "được", "vs": "với", "mik": "mình", "mk": "mình", "e": "em", "a": "anh", "c": "chị", "m": "mày", "t": "tao",
    "nc": "nói chuyện", "nch": "nói chuyện", "oke": "ok", "okie": "ok", "uk": "ừ", "uhm": "ừ", "uh": "ừ", "ny": "người yêu", "cx": "cũng",
    "cg": "cũng", "j": "gì", "gi": "gì",
}
SPAM_KEYWORDS = ["vay vốn", "lãi suất", "giải ngân", "bán sim", "tuyển dụng"]
ADS_KEYWORDS = ["mua ngay", "giảm giá", "khuyến mãi", "sale off", "click link", "inbox", "đặt hàng", "liên hệ ngay", "giá sốc", "hot deal", "freeship", "miễn phí vận chuyển"]
REACTIONS = ["ok", "oke", "haha", "hehe", "nice"]

TOKEN = r"[\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; SQL has no such function."""
    return text.str.normalize("NFKC")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    return F.array_distinct(every(text, URL))


def hashtags(text: Column) -> Column:
    """Lower-cased tags without their sign, in order of appearance."""
    return F.array_distinct(F.transform(every(text, HASHTAG, 1), F.lower))


def emojis(text: Column) -> Column:
    return every(text, EMOJI)


def words(text: Column) -> Column:
    return every(text, TOKEN)


def segmented_tag(tag: Column) -> Column:
    """A hashtag as words: camel case, separators and digits apart."""
    tag = F.regexp_replace(tag, r"([a-z])([A-Z])", "$1 $2")
    tag = F.translate(tag, "_-", "  ")
    tag = F.regexp_replace(tag, r"([A-Za-z])(\d)", "$1 $2")
    return squeeze(F.regexp_replace(tag, r"(\d)([A-Za-z])", "$1 $2"))


def bounded(word: str) -> str:
    """Pattern of a word that stands alone, in any letter case."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{word}\E(?![\p{{L}}\p{{N}}_])"


def with_replacements(text: Column, table: dict[str, str]) -> Column:
    """The table's words replaced one after the other, in its order."""
    return reduce(lambda t, pair: F.regexp_replace(t, bounded(pair[0]), pair[1]), table.items(), text)


def processing_text(raw: Column, tags: Column) -> Column:
    """Without links, handles and emoji; hashtags as words; repeats squeezed; slang spelled out."""
    text = F.regexp_replace(raw, URL, " ")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])" + HANDLE, " ")
    text = F.regexp_replace(text, EMOJI, " ")
    text = F.aggregate(tags, text, lambda t, tag: F.replace(t, F.concat(F.lit("#"), tag), F.concat(F.lit(" "), segmented_tag(tag), F.lit(" "))))
    text = F.regexp_replace(text, r"([A-Za-z\x{00C0}-\x{1EF9}])\1{2,}", "$1$1")
    text = squeeze(F.regexp_replace(text, r"([!?.,])\1+", "$1"))
    return squeeze(with_replacements(text, SLANG))


def compact(text: Column) -> Column:
    """Lower case; runs of white space, underscores and punctuation other than #:+- as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}#:+-]+", " "))


def template_key(text: Column) -> Column:
    """The text with tags and numbers replaced by their kind: equal for posts from one template."""
    key = F.replace(text, F.lit("<url>"), F.lit(" <url> "))
    key = F.regexp_replace(key, r"#[\p{L}\p{N}_]+", " <tag> ")
    return squeeze(F.regexp_replace(key, r"[0-9]+", " <num> "))


def is_repost(compact_text: Column) -> Column:
    return compact_text.startswith("rt ") | compact_text.startswith("repost ") | compact_text.startswith("shared from ")


def merged_content(transcription: Column, caption: Column, comments: Column) -> Column:
    """Parts without trailing punctuation, joined into sentences."""
    bare = lambda x: F.regexp_replace(F.trim(x), r"[.!?;:,]+$", "")
    parts = F.concat(F.array(transcription, caption), F.coalesce(comments, F.array().cast("array<string>")))
    parts = F.filter(F.transform(parts, bare), lambda x: x.isNotNull() & (x != ""))
    return F.regexp_replace(F.array_join(parts, ". "), r"\.{2,}", ".")


def clean_text(text: Column) -> Column:
    """Teencode spelled out; links, emoji and hashtag signs gone; lower case."""
    text = with_replacements(text, TEENCODE)
    text = F.regexp_replace(F.regexp_replace(text, CLEAN_URL, ""), CLEAN_EMOJI, "")
    return F.lower(squeeze(F.regexp_replace(text, r"#([\p{L}\p{N}_]+)", "$1")))


def text_stats(raw: Column, clean: Column) -> Column:
    """Length, shortness, hashtag ratio, reduction, phone and spam words of a cleaned text."""
    n_words = F.size(F.filter(F.split(raw, r"\s+"), lambda x: x != ""))
    n_tags = F.size(every(raw, r"#[\p{L}\p{N}_]+"))
    lowered = F.lower(raw)
    spam = reduce(lambda a, w: a | lowered.contains(w), SPAM_KEYWORDS, F.lit(False))
    return F.struct(
        F.length(clean).alias("total_length"), (F.length(clean) < 10).alias("is_too_short"),
        F.when(n_words > 0, F.round(n_tags / n_words, 4)).otherwise(0.0).alias("hashtag_ratio"),
        F.when(F.length(raw) > 0, F.round(1 - F.length(clean) / F.length(raw), 4)).otherwise(0.0).alias("reduction_ratio"),
        raw.rlike(PHONE).alias("has_phone"), spam.alias("has_spam_keyword"))


def simple_spam(text: Column) -> Column:
    """Why a text looks like spam: too short, few different words, advertising words."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    diversity = F.size(F.array_distinct(tokens)) / F.size(tokens)
    ads = F.filter(F.array(*map(F.lit, ADS_KEYWORDS)), lambda w: F.contains(F.lower(text), w))
    return F.array_compact(F.array(
        F.when(F.length(F.trim(text)) < 5, F.lit("text_too_short")),
        F.when((F.size(tokens) > 0) & (diversity < 0.3), F.concat(F.lit("low_word_diversity:"), F.format_number(diversity, 2))),
        F.when(F.size(ads) > 0, F.concat(F.lit("ads_keywords:"), F.array_join(ads, ",")))))


def quality_flags(raw: Column, normalized: Column, compact_text: Column, links: Column, faces: Column, supported: Column) -> Column:
    """Sorted flags of what is wrong with a text."""
    tokens = F.filter(F.split(compact_text, " "), lambda t: ~t.isin("", "url", "mention"))
    n, links_n = F.size(tokens), F.size(links)
    reaction = ((n == 0) & (F.length(raw) > 0)) | ((n <= 3) & F.lower(normalized).isin(REACTIONS))
    flags = F.array_compact(F.array(
        F.when((n <= 2) & (F.size(faces) >= 2), "emoji_dominant"), F.when((n <= 2) & (links_n == 0), "low_information"),
        F.when(n == 0, "no_semantic_content"), F.when(reaction, "reaction_only"),
        F.when((F.size(F.array_distinct(tokens)) <= 2) & (n >= 4), "template_like"), F.when(~supported, "unsupported_language"),
        F.when((links_n >= 2) | ((links_n > 0) & (n <= 3)), "url_heavy")))
    return F.array_sort(flags)


def quality_label(flags: Column) -> Column:
    has = lambda x: F.array_contains(flags, x)
    label = F.when(has("unsupported_language"), "unsupported_language").when(has("no_semantic_content"), "no_semantic_content").when(has("reaction_only"), "reaction_only")
    return label.when(has("emoji_dominant") | has("low_information"), "low_information").when(has("url_heavy") | has("template_like"), "spam_like").otherwise("normal")


#: What each flag takes from a quality of 1. Fixed values.
PENALTY = {"unsupported_language": 0.9, "reaction_only": 0.45, "low_information": 0.3, "url_heavy": 0.2, "template_like": 0.2, "emoji_dominant": 0.15}


def quality_score(flags: Column) -> Column:
    lost = sum((F.when(F.array_contains(flags, k), v).otherwise(0.0) for k, v in PENALTY.items()), F.lit(0.0))
    return F.round(F.greatest(1.0 - lost, F.lit(0.05)), 4)


def alias(text: Column) -> Column:
    """A surface as it is compared with aliases: lower case, signs and quotes gone."""
    return squeeze(F.translate(F.lower(text), "#@\"'`", ""))


def repaired(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1 put right; other texts unchanged."""
    looks_broken = text.rlike(r"[\x{00C3}\x{00C2}][\x{0080}-\x{00BF}]")
    return F.when(looks_broken, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)


def snippet(text: Column, limit: int = 100, mark: str = "...") -> Column:
    """At most limit characters, marked if cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(mark)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an outer expression inside a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(compact_text: Column) -> Column:
    """Distinct word triples; five-character runs where there are fewer words; else the text."""
    def of_tokens(tokens: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.array_join(F.slice(tokens, i, F.lit(3)), " "))
        return F.when(F.size(tokens) >= 3, triples).otherwise(let(F.array_join(tokens, ""), of_characters))

    def of_characters(joined: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(joined) - 4), lambda i: F.substr(joined, i, F.lit(5)))
        return F.when(F.length(joined) >= 5, runs).when(F.length(joined) > 0, F.array(joined)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(F.filter(F.split(compact_text, " "), lambda t: t != ""), of_tokens))


def shingle_names(compact_text: Column) -> Column:
    """The same shingles as 64-bit hashes; a word triple's is made from its words' hashes, no string is built for it."""
    def of_words(h: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) >= 3, triples).otherwise(F.transform(shingles(compact_text), lambda x: F.xxhash64(x)))

    hashes = F.transform(F.split(compact_text, " "), lambda t: F.xxhash64(t))
    return F.array_distinct(let(F.array_remove(hashes, F.xxhash64(F.lit(""))), of_words))


def shared_share(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets, four digits; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(0.0)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) from SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
