"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh 5, 2, 1 and so on again, and share the words
of all documents by weight; no target is above `MOST` times its source's words, and what
that leaves is shared again by weight until none is above. A source's target is met by
complete epochs first; the fraction that is left goes to the documents with the smallest
keys -ln(u) / quality, u a hash of the doc_id, in order until the words are used up.

Prefix sums within a source, which may hold a third of all rows, run over the square root
of its rows as bins of keys, and then within each bin: no task sees a whole source.

Targets are levels of a window over the table of sources (one narrow row each), in the order
in which sources fill up: no number of sources is too large for the driver.

Defined cases. A null text has size 0 and is taken 0 times. Null is a source of its own.
Rows that repeat a doc_id are taken one by one; ties of keys go by (doc_id, size, the text's
hash). A source without words has target 0. A very long text counts whole, and if it crosses
the target, gives its leading words. An empty table gives no rows. Other columns are kept by
`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh

WEIGHTS, MOST = (5, 2, 1), 3
#: A table of at most so many sources is broadcast; a larger one is joined by a shuffle, in which Spark splits hot sources.
BROADCAST = 100_000
#: Sampling weights of documents with quality 1, 0 and unknown.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """by_source (source, source_size) with nth, its place in code point order, and target, its words in the mix.

    Sources are full in the order of size / weight. What the full ones leave is shared by weight; the first source
    that its share does not fill, and all after it, get that share.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = by_source.withColumn("nth", nth)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "nth")
    every = Window.partitionBy()
    rows = rows.withColumns({
        "place": F.row_number().over(order), "all": F.sum("source_size").over(every),
        "before": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("source_size"),
        "share": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    rows = rows.withColumn("level", (F.col("all") - most * F.col("before")) / F.col("share"))
    open_ = F.when(F.col("level") * F.col("w") <= most * F.col("source_size"), F.struct("place", "level"))
    rows = rows.withColumn("first", F.min(open_).over(every))
    goal = F.when(F.col("place") < F.col("first.place"), (most * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("w"))
    return rows.select("source", "source_size", "nth", goal.alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1] that depends on the doc_id only."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return (bits + 1) / F.lit(float(2**52))


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, epochs, rest, before, text_key.

    taken = epochs * size, plus the words of [before, before + size) that lie below rest.
    quality: doc_id and quality (1 or 0); a doc_id with both counts as 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
    by_source = Scratch(docs.sparkSession).write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goals = targets(by_source.select("source", "source_size")).drop("source_size")
    words = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    sources = by_source.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sources = sources.select(F.col("source").alias("_source"), "nth", "source_size", "target", epochs.alias("epochs"), F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int").alias("bins"))
    sources = sources.withColumn("rest", (words - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = F.broadcast(sources) if by_source.count() <= BROADCAST else sources
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["_source"])).drop("_source")

    weight = F.lit(QUALITY[None])
    if quality is not None:
        known = quality.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
        rows = rows.join(known, rows["doc_id"] == F.col("_id"), "left").drop("_id")
        weight = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None])
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / weight)
    rows = rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("bins")), F.col("bins") - 1))
    earlier = Window.partitionBy("nth").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("nth", "bin").agg(F.sum("size").alias("words")).select("nth", "bin", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("nth", "bin").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in_bin", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["nth", "bin"])
    before = F.col("base") + F.col("_in_bin")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs", "rest", before.alias("before"), "text_key")


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The documents of the mix, whole and as often as it takes them; the one that crosses the target is in if half of it is."""
    found = mix(docs, quality)
    extra = (F.col("size") > 0) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra.cast("int")).otherwise(0)
    doc, key, many, nth = fresh(docs, "doc", "key", "copies", "copy")
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), copies.alias(many)).filter(F.col(many) > 0)
    found = found.groupBy(doc, key).agg(F.max(many).alias(many))
    taken = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[doc]) & (F.xxhash64(docs["text"]) == found[key]))
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM sources
), levels AS (
  SELECT *, (total - 3 * (sum(source_size) OVER (ORDER BY k) - source_size)) / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ordered
), first_below AS (
  SELECT min(k) AS k FROM levels WHERE level * w <= 3 * source_size
), goals AS (
  SELECT l.source, l.source_size, CASE WHEN l.k < f.k THEN CAST(3 * l.source_size AS DOUBLE) ELSE x.level * l.w END AS target
  FROM levels l CROSS JOIN first_below f JOIN levels x ON x.k = f.k
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goals
), keyed AS (
  SELECT s.doc_id, s.size, b.*, -ln((CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)
    / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = s.doc_id
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
)
SELECT doc_id, source, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, words - epochs * source_size - before)) AS BIGINT) AS taken FROM placed
"""
