"""Removal of repeated lines by an exact set-similarity join, in SQL functions only.

A line is what stands between line feeds; its tokens are the distinct words in it. A line
goes if an earlier one, by (doc_id, place in the text), has token sets of Jaccard
similarity 0.75 or more with it; lines are judged on the input, not on what is left.

Equal lines (128 bits of hash) are one class, known by its first place; only classes are
joined. Tokens are ordered by rarity (how often their hash bucket occurs in
the corpus; ties by hash). Two sets that are similar enough share a token among the first
n - ceil(0.75 n) + 1 of their n tokens, and two among one token more. So a class is listed
under each of the former that is not frequent, and, as shared tokens may all be frequent,
under each pair of frequent ones among the latter: no list is that of a frequent word.
Classes that meet must also have fitting sizes, enough tokens left from the meeting
place on, and parities of 128 bits of their tokens that differ in no more bits than sets
so similar can. What passes is verified on the full sets. All filters are necessary
conditions, so no pair is lost.

A class needs only one earlier class to go. Before the join each class meets a few of the earliest
classes of a few buckets of equal minima (sums before the shuffle, one row a class and bucket):
that settles most of a large group of like lines in linear work, and the join is for what is
still open.

Defined cases. A null text has no lines; a line without words is in no class and stays.
An empty text has one line without words. Rows that repeat a doc_id are texts of their
own; rows alike in id and text are one text, and each is cut alike. A null doc_id comes
before all others. Lines alike in place (rows that share an id) count in the order of their
texts' hashes. Very long lines are sets like others, of any size. An empty table gives no
rows. Clashing columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, fresh

PERCENT = 75
#: Hash buckets whose counts order tokens; their table is this long at any scale.
BUCKETS = 1 << 18
#: Levels to a doubling of a bucket's count, and the count from which a token is frequent.
LEVELS, FREQUENT = 4, 1 << 14
#: Lists of single tokens, and the four buckets of minima, are gone through in so many shares, so that the disk holds one share at a time.
TURNS, BUCKET_TURNS = 2, 2
#: Shares of a bucket that have an earliest class each.
LEADERS = 8
#: Stands for a null id.
NO_ID = -(1 << 63)
BLANK = r"[\x09-\x0D\x20]+"
PLACE = ("_doc", "nth", "_key")


def spaced(text: Column) -> Column:
    """The text with a plain space in the place of each other blank but the line feed: splitting by one character is fast."""
    for blank in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def tokens(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(spaced(line), " "), ""))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line that has words, named by c and d."""
    rows = docs.select("_doc", "_key", F.posexplode(F.split("text", "\n")).alias("nth", "line")).filter(F.trim("line", F.lit(" \t\x0b\x0c\r")) != "")
    return rows.withColumns({"c": F.xxhash64("line"), "d": F.xxhash64(F.lit(9), "line")})


def rarity(docs: DataFrame) -> Column:
    """An array that holds, for each bucket, LEVELS times the binary logarithm of its tokens' occurrences."""
    words = docs.select(F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("t")).filter("t <> ''")
    counts = words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    level = [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        level[r["b"]] = min(127, int(LEVELS * math.log2(1 + r["count"])))
    return table_of(level)


def table_of(values: list[int]) -> Column:
    """The numbers as an array: a literal, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def parities(bit: Column) -> Column:
    """The bits that the tokens' lowest 7 bits name in the table, summed modulo 2."""
    return F.aggregate("h", F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(bit[x.bitwiseAND(F.lit(127))]))


def listed(n: Column) -> Column:
    """Length of the prefix in which similar sets share a token."""
    return (n - F.ceil(n * PERCENT / 100) + 1).cast("int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_doc and _key tell rows apart and are never null, whatever the input; text is the text."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_key"), text.alias("text"))


def classes_of(docs: DataFrame, level: Column) -> DataFrame:
    """One row per different line: its name, first place, lines, tokens n, the prefix and one token more, parities, minima."""
    rows = lines_of(docs).groupBy("c", "d").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("lines"), F.first("line").alias("line"))
    # Sets as hashes; each step is a projection of its own, so that nothing is computed twice.
    about = ["c", "d", "first", "lines"]
    rows = rows.select(*about, F.array_distinct(F.array_remove(F.transform(F.split(spaced(F.col("line")), " "), lambda x: F.xxhash64(x)), F.xxhash64(F.lit("")))).alias("h"))
    ranks = F.transform("h", lambda x: F.shiftleft(level[x.bitwiseAND(F.lit(BUCKETS - 1))], 56).bitwiseOR(F.shiftrightunsigned(x, 8)))
    other = F.transform("h", lambda x: x.bitwiseXOR(F.lit(0x5555555555555555)))
    bits = [1 << k for k in range(63)] + [-(1 << 63)]
    parity = [parities(table_of(t)).alias(f"m{k}") for k, t in enumerate((bits + [0] * 64, [0] * 64 + bits))]
    rows = rows.select(*about, F.size("h").alias("n"), F.sort_array(ranks).alias("r"), *parity, F.array_min("h").alias("a1"), F.array_max("h").alias("b1"), other.alias("o"))
    rows = rows.select(*about, "n", F.slice("r", F.lit(1), listed(F.col("n")) + 1).alias("r"), "m0", "m1", "a1", "b1", F.array_min("o").alias("a2"), F.array_max("o").alias("b2"))
    # Ranks are sorted, so the frequent tokens are the last. Names of 32 bits are enough to be listed under: two that agree by chance only meet for nothing.
    frequent = int(LEVELS * math.log2(1 + FREQUENT)) << 56
    rows = rows.withColumns({"rare": F.size(F.filter("r", lambda x: x < frequent)), "p": F.transform("r", lambda x: F.hash(x))})
    minima = F.array(*[F.xxhash64(F.lit(k), a, b) for k, (a, b) in enumerate((("a1", "b1"), ("a2", "b2"), ("a1", "b2"), ("a2", "b1")))])
    return rows.select(*about, "n", F.col("p").alias("r"), "rare", "m0", "m1", minima.alias("minima"))


def may_be_similar(x: str, y: str) -> Column:
    """Size and parity filters on the columns of two classes: both are necessary for similarity."""
    n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in ("m0", "m1")), F.lit(0))
    return (100 * F.least(n_x, n_y) >= PERCENT * F.greatest(n_x, n_y)) & (differ * (100 + PERCENT) <= (100 - PERCENT) * (n_x + n_y))


def with_leaders(classes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each class and the earliest classes (one of each of LEADERS shares) of every bucket of minima it is in, of this turn's, if they come before it and may be similar."""
    several = 4 // BUCKET_TURNS
    rows = classes.select(F.explode(F.slice("minima", turn * several + 1, several)).alias("key"), F.struct("first", "n", "m0", "m1").alias("x"))
    share = F.pmod(F.xxhash64("x.first"), F.lit(LEADERS))
    least = [F.min(F.when(share == k, F.col("x"))).alias(f"y{k}") for k in range(LEADERS)]
    leaders = rows.groupBy("key").agg(*least, F.count("*").alias("members")).filter("members > 1")
    met = rows.join(leaders.select("key", F.array_compact(F.array(*[f"y{k}" for k in range(LEADERS)])).alias("ys")).hint("shuffle_hash"), "key")
    met = met.select("x", F.explode("ys").alias("y")).filter((F.col("x.first") > F.col("y.first")) & may_be_similar("x", "y"))
    return met.select(F.col("x.first").alias("a"), F.col("y.first").alias("b")).distinct()


def listings(classes: DataFrame, turn: int) -> DataFrame:
    """A narrow row for each of this turn's lists that a class is in: p, doc, line (nth twice, plus 1 if open), key, sizes (n and the meeting place), parities.

    The last turn has the pairs of frequent tokens, the others share the rest.
    """
    if turn < TURNS:
        lists = F.slice("r", F.lit(1), F.least(F.col("rare"), listed(F.col("n")))).cast("array<bigint>")
        classes = classes.select("first", "open", "n", "m0", "m1", "rare", F.posexplode(lists).alias("at", "p")).filter(F.pmod("p", F.lit(TURNS)) == turn)
    else:
        # A single token is listed whatever it is.
        pairs = F.expr("flatten(transform(slice(r, rare + 1, size(r)), (x, i) -> transform(slice(r, cast(rare + i + 2 as int), size(r)), y -> xxhash64(x, y))))")
        lists = F.when(F.col("n") == 1, F.col("r").cast("array<bigint>")).otherwise(pairs)
        classes = classes.filter(F.col("rare") < F.size("r")).select("first", "open", "n", "m0", "m1", "rare", F.explode(lists).alias("p"))
        # All pairs count as met at the first frequent token, where no less is left than at their own place.
        classes = classes.withColumn("at", F.col("rare"))
    line = F.col("first.nth").cast("long") * 2 + F.col("open").cast("long")
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return classes.select("p", F.col("first._doc").alias("doc"), line.alias("line"), F.col("first._key").alias("key"), sizes.alias("sizes"), "m0", "m1")


def with_earlier(classes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each class that is still open and every earlier one that shares a list with it and may be similar."""
    rows = listings(classes, turn)
    # Most pairs of a list are refuted, and a merge join goes through them several times faster than a hash join.
    x, y = rows.alias("x"), rows.alias("y").hint("merge")
    n = {s: F.shiftright(F.col(f"{s}.sizes"), 32) for s in "xy"}
    left = {s: n[s] - F.col(f"{s}.sizes").bitwiseAND(F.lit(0xFFFFFFFF)) for s in "xy"}
    nth = {s: F.shiftright(F.col(f"{s}.line"), 1) for s in "xy"}
    total = n["x"] + n["y"]
    later = (F.col("x.doc") > F.col("y.doc")) | ((F.col("x.doc") == F.col("y.doc")) & ((nth["x"] > nth["y"]) | ((nth["x"] == nth["y"]) & (F.col("x.key") > F.col("y.key")))))
    # One condition on both sides, so that the sides stay alike and one shuffle serves both.
    open_and_later = F.least(F.col("x.line").bitwiseAND(F.lit(1)), later.cast("long")) == 1
    sizes = 100 * F.least(n["x"], n["y"]) >= PERCENT * F.greatest(n["x"], n["y"])
    # J >= t needs t / (1 + t) of both sizes in common: the first shared token and what follows it must be enough.
    common = F.least(left["x"], left["y"]) * (100 + PERCENT) >= PERCENT * total
    differ = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in ("m0", "m1")), F.lit(0))
    met = x.join(y, (F.col("x.p") == F.col("y.p")) & sizes & common & open_and_later & (differ * (100 + PERCENT) <= (100 - PERCENT) * total))
    place = {s: F.struct(F.col(f"{s}.doc").alias("_doc"), nth[s].cast("int").alias("nth"), F.col(f"{s}.key").alias("_key")) for s in "xy"}
    return met.select(place["x"].alias("a"), place["y"].alias("b")).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """_d, _k and `_gone`, the places of the lines to remove, for each keyed text that has any."""
    scratch = Scratch(docs.sparkSession)

    def per_text(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("_doc").alias("_d"), F.col("_key").alias("_k")).agg(F.collect_set("nth").alias(name))

    def turns(step, classes: DataFrame, many: int) -> DataFrame:
        found = []
        for turn in range(many):
            found.append(scratch.write(step(classes, turn)))
            scratch.sweep()
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.union(more)
        return pairs.distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """First places of the classes a with a similar earlier class b, by their full sets, read from the texts of their first places."""
        pairs = scratch.write(pairs)
        involved = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct().select("x.*")
        # The same join at every size: texts are too many to be looked up in one table.
        held = of_texts(docs, per_text(involved, "_wanted").hint("shuffle_hash"), "inner")
        held = held.select("_doc", "_key", F.split("text", "\n").alias("lines"), F.explode("_wanted").alias("nth"))
        held = held.select(F.struct(*PLACE).alias("x"), tokens(F.get("lines", F.col("nth"))).alias("t")).dropDuplicates(["x"])
        sets = scratch.write(held.select("x", F.transform("t", lambda x: F.xxhash64(x)).alias("t")))
        side = lambda s: sets.select(F.col("x").alias(s), F.col("t").alias(f"t_{s}"))
        joined = pairs.join(side("b").hint("shuffle_hash"), "b").join(side("a").hint("shuffle_hash"), "a").withColumn("s", F.size(F.array_intersect("t_a", "t_b")))
        found = scratch.write(joined.filter(100 * F.col("s") >= PERCENT * (F.size("t_a") + F.size("t_b") - F.col("s"))).select(F.col("a").alias("first")).distinct())
        scratch.drop(sets, pairs)
        scratch.sweep()
        return found

    named = scratch.write(classes_of(docs, rarity(docs)))
    scratch.sweep()
    later = confirmed(turns(with_leaders, named, BUCKET_TURNS))
    places = scratch.write(named.select("c", "d", "first", "lines"))
    scratch.sweep()
    left = scratch.write(named.join(later.withColumn("open", F.lit(False)).hint("shuffle_hash"), "first", "left").select("first", F.coalesce("open", F.lit(True)).alias("open"), "n", "r", "rare", "m0", "m1"))
    scratch.drop(named)
    scratch.sweep()
    later = scratch.write(later.union(confirmed(turns(with_earlier, left, TURNS + 1))).withColumn("later", F.lit(True)))
    scratch.drop(left)
    scratch.sweep()
    # Only lines of classes that occur twice or go altogether can go.
    status = places.join(later.hint("shuffle_hash"), "first", "left").filter("lines > 1 or later")
    here = F.struct(*PLACE)
    gone = lines_of(docs).drop("line").join(status.hint("shuffle_hash"), ["c", "d"]).filter(F.coalesce("later", F.lit(False)) | (here != F.col("first")))
    return per_text(gone, "_gone")


def of_texts(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return left.join(right, (left["_doc"] == right["_d"]) & (left["_key"] == right["_k"]), how).drop("_d", "_k")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, _key (the text's hash), n_lines, n_removed and kept_text (null for a null text)."""
    docs = keyed(docs, id_col, text_col)
    found = of_texts(docs, repeated_lines(docs).hint("shuffle_hash")).withColumns({"_lines": F.split("text", "\n"), "_gone": F.coalesce("_gone", F.array().cast("array<int>"))})
    kept = F.when(F.size("_gone") == 0, F.col("text")).otherwise(F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    return found.select(
        F.nullif("_doc", F.lit(NO_ID)).alias("doc_id"), "_key", F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"), kept.alias("kept_text"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines, all columns kept; n_chars, if there, is counted anew."""
    inner = keyed(docs, "doc_id", "text")
    doc, key, gone = fresh(docs, "doc", "key", "gone")
    found = repeated_lines(inner).select(F.col("_d").alias(doc), F.col("_k").alias(key), F.col("_gone").alias(gone))
    here = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == found[doc]) & (F.xxhash64(docs["text"]) == found[key])
    out = docs.join(found.hint("shuffle_hash"), here, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(gone).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[v.alias(c) for c, v in columns.items()])


SQL = r"""
WITH split_ AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents
), lines AS (
  SELECT doc_id, nth, line, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS t FROM split_
), classes AS (
  SELECT line, any_value(t) AS t, any_value(len(t)) AS n, min(struct_pack(doc_id, nth)) AS first FROM lines WHERE len(t) > 0 GROUP BY line
), words AS (
  SELECT line, n, first, unnest(t) AS w FROM classes
), met AS (
  SELECT a.line AS a, b.line AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, any_value(a.first) AS first_a, any_value(b.first) AS first_b, count(*) AS s
  FROM words a JOIN words b ON a.w = b.w AND a.first < b.first AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.line, b.line
), later AS (
  SELECT DISTINCT b AS line FROM met WHERE 100 * s >= 75 * (n_a + n_b - s)
), marked AS (
  SELECT l.doc_id, l.nth, l.line, coalesce(x.line IS NOT NULL OR c.first <> struct_pack(doc_id := l.doc_id, nth := l.nth), FALSE) AS gone
  FROM lines l LEFT JOIN classes c ON c.line = l.line LEFT JOIN later x ON x.line = l.line
)
SELECT d.doc_id, count(m.nth) AS n_lines, CAST(count(*) FILTER (m.gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.nth) FILTER (NOT m.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
