"""MinHash near-duplicate classes by tensored banding, every link confirmed on full sets.

Two small collections of half keys (each the hash of `ROWS` minima) are computed per
document; table (i, j) is keyed by half i of the first and half j of the second. So
HALVES^2 tables cost only 2 * HALVES * ROWS minhashes. Only halves that some other
document shares enter a table key, since a table key is shared only if both its halves are.

Recall. Two sets of similarity s meet in some table with probability
(1 - (1 - s^ROWS)^HALVES)^2: 0.9995 at s = 0.75, 0.99999 at 0.85. Candidates whose
sketches of `SKETCH` minima disagree so much that a similarity of 0.75 would show it with
probability below 3e-4 are not compared. All other candidates in different components
are compared on their full sets, so a link is never claimed wrongly. A few star rounds
merge most of a large group first, so the pairs compared are those that decide something:
in the last round only classes outside the largest component of some table key meet the rest.

Defined cases. A null text or one without words has an empty set and links with nothing.
Fewer than five words: the whole sequence is the one shingle. Equal sets (128 bits of hash)
form one class, compared once. A very long text is one set, worked on alone. Rows that
repeat a doc_id are one document each. A row without a doc_id is compared only with equal
sets and is never `kept`. Ties have no part: the smallest id names a component. An empty
table gives no rows. Further input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .components import components
from .storage import Scratch, fresh

WIDTH, PERCENT = 5, 75
ROWS, HALVES = 2, 10
#: Minima that the sketch keeps four bits of; 16 to a long.
SKETCH = 512
#: (longs, minima that must agree in them): four-bit agreement is 0.766 at similarity 0.75, less 3.7 deviations.
AGREE = ((6, 58), (32, 356))
#: Star rounds that merge the bulk of large groups before what is left is compared exhaustively.
STARS = 3

_rng = np.random.default_rng(75)
MULTIPLY = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, halves array<long>, sketch array<long>"


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased texts, sorted within each, with owners and begins."""
    raw, offsets = T.text_buffer(texts)
    raw = T.LOWER[raw]
    starts, ends, first = T.word_bounds(raw, offsets)
    return T.distinct(*T.shingles(T.word_hashes(raw, starts, ends), first, WIDTH))


def names(values: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """128 bits in two columns for each set; equal sets have equal names."""
    if not len(begin):
        return [np.zeros(0, np.int64)] * 2
    size = np.diff(np.append(begin, len(values))).astype(T.U64)
    return [T.mix(np.add.reduceat(T.mix(x), begin) + size).view(np.int64) for x in (values + T.BASE, values ^ T.STEP)]


def minima(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SKETCH minima of each set."""
    low = (values >> T.U64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.empty((len(begin), SKETCH), np.uint32)
    work = np.empty_like(low)
    for k in range(SKETCH):
        np.bitwise_xor(low, FLIP[k], out=work)
        np.multiply(work, MULTIPLY[k], out=work)
        out[:, k] = np.minimum.reduceat(work, begin)
    return out


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in T.slices(texts):
            values, owner, begin = sets_of(texts.slice(a, b - a))
            n = b - a
            size = np.bincount(owner, minlength=n).astype(np.int64)
            name = np.zeros((2, n), np.int64)
            halves, sketch = np.zeros((n, 2 * HALVES), np.int64), np.zeros((n, SKETCH // 16), np.int64)
            if len(begin):
                rows = owner[begin]
                name[:, rows] = names(values, begin)
                low = minima(values, begin)
                half = np.zeros((len(rows), 2 * HALVES), T.U64)
                for r in range(ROWS):
                    half = T.mix(half * T.BASE + low[:, r : 2 * HALVES * ROWS : ROWS].astype(T.U64) + T.U64(1))
                halves[rows] = T.mix(half + np.arange(2 * HALVES, dtype=T.U64) * T.STEP).view(np.int64)
                shift = np.arange(16, dtype=T.U64) * T.U64(4)
                nibbles = (T.mix(low.astype(T.U64)) & T.U64(15)).reshape(len(rows), SKETCH // 16, 16) << shift
                sketch[rows] = np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.record_batch(
                [batch.column("doc_id").slice(a, n).cast(pa.int64()), pa.array(size), pa.array(name[0]), pa.array(name[1]), lists(halves), lists(sketch)],
                names=["doc_id", "n_shingles", "h1", "h2", "halves", "sketch"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in T.slices(texts):
            values, owner, begin = sets_of(texts.slice(a, b - a))
            cuts = np.append(begin, len(values)).astype(np.int32)
            yield pa.record_batch(
                [*map(pa.array, names(values, begin)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.view(np.int64)))],
                names=["h1", "h2", "items"])


def agreeing(s_a: str, s_b: str, *bounds: tuple[int, int]) -> Column:
    """Whether two sketches may be of sets with similarity 0.75, by the first longs of them."""
    ones = F.lit(0x1111111111111111).cast("long")

    def differing(i: int) -> Column:
        x = F.col(s_a)[i].bitwiseXOR(F.col(s_b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))

    out = F.lit(True)
    for longs, agree in bounds:
        out &= 16 * longs - sum((differing(i) for i in range(longs)), F.lit(0)) >= agree
    return out


def first_meeting() -> Column:
    """Whether x and y, which share the i-th half of the first collection, share none before it and some of the second: a table, and no pair twice."""
    before, second = F.lit(True), F.lit(False)
    for k in range(HALVES):
        before &= (F.col("x.i") <= k) | (F.col("x.short")[k] != F.col("y.short")[k])
        second |= F.col("x.short")[HALVES + k] == F.col("y.short")[HALVES + k]
    return before & second


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link on their full sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    joined = pairs.join(right, "b").join(left, "a").withColumn("shared", shared)
    return joined.filter(100 * F.col("shared") >= PERCENT * union).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    class_id: smallest doc_id with an equal set (null for an empty one). component_id:
    smallest doc_id reachable over links of similarity 0.75 or more. kept: they are equal.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = scratch.write(docs.mapInArrow(signatures, SIGNATURE))
    classes = every.filter("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    # A class is known by a number from here on; the numbers are kept with the table.
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()))
    members = scratch.write(every.select("doc_id", "n_shingles", "h1", "h2"))
    scratch.drop(every)
    scratch.sweep()

    # Halves that two classes share, back with their class; then the tensored table keys.
    half = classes.filter("n_shingles > 1").select("node", F.posexplode("halves").alias("at", "half"))
    common = half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    mine = half.join(common, "half").groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < HALVES, F.col("half"))).alias("first"), F.collect_list(F.when(F.col("at") >= HALVES, F.col("half"))).alias("second"))
    keys = mine.select("node", F.explode("first").alias("h"), "second").select("node", "h", F.explode("second").alias("g")).select(F.xxhash64("h", "g").alias("key"), "node")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = scratch.write(keys.join(several, "key"))
    scratch.sweep()

    held = buckets.select("node").distinct().join(classes, "node")
    held = scratch.write(held.select("node", "h1", "h2", "class_id", "halves", "sketch"))
    texts = docs.join(held.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(full_sets, "h1 long, h2 long, items array<long>").join(held.select("h1", "h2", "node"), ["h1", "h2"])
    sets = scratch.write(sets.select("node", "items").dropDuplicates(["node"]))
    places = scratch.write(classes.select("node", "h1", "h2", "class_id"))
    scratch.drop(classes)
    scratch.sweep()

    def with_sketches(pairs: DataFrame, longs: int) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(held.select(F.col("node").alias(s), F.slice("sketch", 1, longs).alias(f"s_{s}")), s)
        return pairs

    labels = scratch.write(held.select("node", F.col("node").alias("component")))
    seen = None
    for turn in range(STARS + 1):
        parts = buckets.join(labels, "node")
        if turn < STARS:
            # Buckets that hold more than one component are all that matters; their leaders meet the others.
            leader = F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.col("node"), "node"))
            mixed = parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), leader.alias("leader")).filter("low < high")
            star = parts.join(mixed.select("key", "leader"), "key").filter("node != leader")
            star = star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "component", "leader").distinct()
            at_leader = labels.select(F.col("node").alias("leader"), F.col("component").alias("other"))
            pairs = star.join(at_leader, "leader").filter("component != other").select("a", "b").distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            few, all_ = AGREE
            likely = with_sketches(pairs, few[0]).filter(agreeing("s_a", "s_b", few)).select("a", "b")
            pairs = with_sketches(likely, all_[0]).filter(agreeing("s_a", "s_b", all_)).select("a", "b")
        else:
            # A pair in a bucket but in different components has an end outside the bucket's largest component.
            sizes = parts.groupBy("key", "component").agg(F.count("*").alias("n"))
            mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest")).filter("parts > 1")
            rest = parts.join(mixed.select("key", "largest"), "key").groupBy("node").agg(F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("largest")).alias("outside"))
            short = F.transform("halves", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("short")
            rest = scratch.write(rest.join(held.select("node", "halves", "sketch"), "node").select("node", "component", "outside", "halves", short, "sketch"))
            each = rest.select("node", "component", "outside", "short", "sketch", F.posexplode(F.slice("halves", 1, HALVES)).alias("i", "half"))
            x, y = each.filter("outside").alias("x"), each.alias("y")
            apart = (F.col("x.component") != F.col("y.component")) & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
            met = x.join(y, (F.col("x.half") == F.col("y.half")) & apart & first_meeting() & agreeing("x.sketch", "y.sketch", *AGREE))
            pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        links = scratch.write(confirmed(pairs, sets))
        scratch.sweep()
        seen = pairs if seen is None else seen.union(pairs)
        if not links.limit(1).count():
            continue
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        merged = components(edges.filter("a != b"), scratch).select(F.col("node").alias("component"), F.col("component").alias("to"))
        was, labels = labels, scratch.write(labels.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        scratch.drop(was, links)
        scratch.sweep()

    scratch.drop(buckets, held, sets)
    placed = places.join(labels.withColumnRenamed("component", "top"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    smallest = placed.groupBy("top").agg(F.min("class_id").alias("smallest"))
    found = placed.join(smallest, "top").select("h1", "h2", "class_id", "smallest")
    full = F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1")
    out = members.select("doc_id", "n_shingles", full, "h2").join(found, ["h1", "h2"], "left")
    component = F.coalesce("smallest", "doc_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near-duplicates, all their columns unchanged.

    Rows without a doc_id stay; rows that share a doc_id stay if one of them does.
    """
    (name,) = fresh(docs, "id")
    found = near_duplicates(docs).groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("stays")).filter("not stays").select(name)
    return docs.join(found, docs["doc_id"] == found[name], "left_anti")
