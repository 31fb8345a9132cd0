"""Removal of long repeated passages, found by recompression.

A text is a string of words. Each naming round renames it: a run of one symbol becomes one
symbol; then every symbol tosses a coin that depends only on its name and the round, and
a heads followed by a tails becomes one symbol. Names are hashes of what they stand for,
so equal substrings get equal interior symbols in all documents, in any partition, without
a table of names that each task would have to hold. With each symbol goes the span of words
that decides it (its own words and the neighbours that its boundaries depend on).

If a window repeats, so does every symbol decided inside it. So each Spark round (`LEVELS`
naming rounds deep) counts the names of the symbols decided inside windows that are still
open, over all documents: a name that occurs once closes all windows that hold its span,
shared names keep them open, and the next round looks at longer symbols in what is left.
The windows that shared symbols propose in the end are verified: 128 bits of hash of the
window itself are counted over all documents, and those that occur once are struck off. No
window is judged on a part of the corpus, and none that repeats can be lost: a window that
holds no symbol's span simply stays open.

Defined cases. A null or empty text has no words, and its kept text is empty. A text with
fewer words than the window loses nothing. A very long text is worked on alone, whole (up to
2^28 words). Rows that are alike in id and text are copies of one another: their windows
repeat. Ties have no part: every occurrence of a repeated window goes. An empty table gives
no rows. Ids may be null. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .storage import Scratch

WINDOW = 35
#: Naming rounds behind the symbols that each Spark round counts.
LEVELS = (4, 7)
#: A span that reaches over a text's edge: such a symbol rules out nothing.
FAR = 1 << 40


def runs_named(sym, doc, low, high, at, words):
    """Each run of one symbol within a text, of one too, becomes one symbol; its neighbours decide where it ends.

    A neighbour whose nearest word differs from the word in its place in the symbol is another symbol whatever it is:
    that word is all the run depends on. Else all that decides the neighbour counts.
    """
    n = len(sym)
    same = np.zeros(n, bool)
    same[1:] = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = np.where(length > 1, T.mix(sym[first] + length.astype(T.U64) * T.STEP), sym[first])
    begin, end = at[first], np.append(at[first[1:]], len(words))
    own_end = np.append(at[1:], len(words))[first]
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    low_before = np.where(words[begin - 1] != words[own_end - 1], begin - 1, low[before])
    high_after = np.where(words[np.minimum(end, len(words) - 1)] != words[begin], end + 1, high[after])
    low_before = np.where((first > 0) & (doc[before] == doc[first]), low_before, -FAR)
    high_after = np.where((last < n - 1) & (doc[after] == doc[first]), high_after, FAR)
    return name, doc[first], np.minimum(np.minimum.reduceat(low, first), low_before), np.maximum(np.maximum.reduceat(high, first), high_after), begin


def pairs_named(sym, doc, low, high, at, turn: int):
    """Every heads-tails pair within a text becomes one symbol; the others depend on the neighbour that they missed."""
    n = len(sym)
    salt = T.mix(np.array([turn + 1], T.U64))[0]
    heads = (T.mix(sym + salt) >> T.U64(63)).astype(bool)
    joined = doc[1:] == doc[:-1]
    pair, second = np.zeros(n, bool), np.zeros(n, bool)
    pair[:-1] = heads[:-1] & ~heads[1:] & joined
    second[1:] = pair[:-1]
    low_before, high_after = np.full(n, -FAR), np.full(n, FAR)
    low_before[1:] = np.where(joined, low[:-1], -FAR)
    high_after[:-1] = np.where(joined, high[1:], FAR)
    alone = ~pair & ~second
    low = np.where(alone & ~heads, np.minimum(low, low_before), low)
    high = np.where(alone & heads, np.maximum(high, high_after), high)
    keep = np.flatnonzero(~second)
    paired, mate = pair[keep], np.minimum(keep + 1, n - 1)
    name = np.where(paired, T.mix(sym[keep] * T.BASE + T.mix(sym[mate])), sym[keep])
    return name, doc[keep], np.where(paired, np.minimum(low[keep], low[mate]), low[keep]), np.where(paired, np.maximum(high[keep], high[mate]), high[keep]), at[keep]


def symbols(words: np.ndarray, first: np.ndarray, rounds: int):
    """Symbols after so many rounds: name, text, and the span of words that decides each (in places of the whole batch)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = np.arange(len(words), dtype=np.int64)
    state = (words, doc, low, low + 1, low)
    for turn in range(rounds):
        if len(words):
            state = pairs_named(*runs_named(*state, words), turn)
    return state[:4]


def parsed(texts: pa.Array):
    raw, offsets = T.text_buffer(texts)
    starts, ends, first = T.word_bounds(raw, offsets)
    return raw, starts, ends, first, T.word_hashes(raw, starts, ends)


def only(batch: pa.RecordBatch, a: int, b: int, owner: np.ndarray) -> list[pa.Array]:
    """The id columns of the rows that own what was found."""
    at = pa.array(owner + a)
    return [batch.column("id").take(at), batch.column("text_key").take(at)]


def symbol_rows(rounds: int):
    """A row for each symbol that is decided inside some open window; its place packs start, text size and span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in T.slices(texts):
                _, _, _, first, words = parsed(texts.slice(a, b - a))
                name, doc, low, high = symbols(words, first, rounds)
                ok = (low > -1) & (high - low <= WINDOW) & (np.diff(first)[doc] >= WINDOW)
                name, doc, low, high = name[ok], doc[ok], low[ok], high[ok]
                # Windows that hold [low, high) start from high - WINDOW to low.
                upto = np.concatenate([[0], np.cumsum(window_starts(batch.column("ranges").slice(a, b - a), first))])
                ok = upto[low + 1] > upto[np.maximum(high - WINDOW, first[doc])]
                name, doc, low, high = name[ok], doc[ok], low[ok], high[ok]
                place = ((low - first[doc]) << 34) | (np.diff(first)[doc] << 6) | (high - low)
                yield pa.record_batch([pa.array(name.view(np.int64)), *only(batch, a, b, doc), pa.array(place)], names=["name", "id", "text_key", "place"])

    return work


def window_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of window starts [from, to) that stay open: those open before (all, where there is no list) without the ones that a once-only symbol closes."""
    for batch in batches:
        once, before, out = batch.column("once"), batch.column("ranges"), []
        for places, ranges in zip(once, before, strict=True):
            if not places.is_valid:
                out.append(ranges.values.to_numpy(zero_copy_only=False).astype(np.int32))
                continue
            place = places.values.to_numpy(zero_copy_only=False)
            windows = int(place[0] >> 6) % (1 << 28) - WINDOW + 1
            low = place >> 34
            high = low + (place & 63)
            closed = np.zeros(windows + 1, np.int64)
            np.add.at(closed, np.maximum(high - WINDOW, 0), 1)
            np.add.at(closed, np.minimum(low + 1, windows), -1)
            left = np.cumsum(closed)[:-1] == 0
            if ranges.is_valid:
                was, edges = np.zeros(windows + 1, np.int64), ranges.values.to_numpy(zero_copy_only=False)
                was[edges[::2]] += 1
                was[edges[1::2]] -= 1
                left &= np.cumsum(was)[:-1] > 0
            left = np.concatenate([[False], left, [False]])
            out.append(np.flatnonzero(left[1:] != left[:-1]).astype(np.int32))
        yield pa.record_batch([batch.column("id"), batch.column("text_key"), listed(out)], names=["id", "text_key", "ranges"])


def listed(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def window_starts(lists: pa.Array, first: np.ndarray) -> np.ndarray:
    """Which words of the batch start a window that is left; a text without a list had no once-only symbol, so all are."""
    windows = np.maximum(np.diff(first) - WINDOW + 1, 0)
    mark = np.zeros(first[-1] + 1, np.int64)
    for i, x in enumerate(lists):
        if not x.is_valid:
            if windows[i]:
                mark[first[i]] += 1
                mark[first[i] + windows[i]] -= 1
        elif len(x):
            place = x.values.to_numpy() + first[i]
            mark[place[::2]] += 1
            mark[place[1::2]] -= 1
    return np.cumsum(mark)[:-1] > 0


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows left, with their places."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in T.slices(texts):
            _, _, _, first, words = parsed(texts.slice(a, b - a))
            at = np.flatnonzero(window_starts(batch.column("ranges").slice(a, b - a), first))
            owner = np.searchsorted(first, at, side="right") - 1
            name, more = (T.span_hashes(words, at, at + WINDOW, base).view(np.int64) for base in (T.STEP, T.BASE))
            yield pa.record_batch([pa.array(name), pa.array(more), *only(batch, a, b, owner), pa.array((at - first[owner]).astype(np.int32))], names=["name", "more", "id", "text_key", "place"])


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: its words outside all repeated windows, joined by one space."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in T.slices(texts):
            raw, starts, ends, first, _ = parsed(texts.slice(a, b - a))
            begins = window_starts(batch.column("ranges").slice(a, b - a), first)
            for i, x in enumerate(batch.column("struck").slice(a, b - a)):
                if x.is_valid:
                    begins[x.values.to_numpy() + first[i]] = False
            cover = np.zeros(first[-1] + WINDOW + 1, np.int64)
            cover[:-WINDOW - 1] += begins
            cover[WINDOW:-1] -= begins
            kept = np.cumsum(cover)[: first[-1]] == 0
            whole, data = [], raw.tobytes()
            for i in range(b - a):
                at = np.flatnonzero(kept[first[i] : first[i + 1]]) + first[i]
                whole.append(b" ".join([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            gone = np.concatenate([[0], np.cumsum(~kept)])
            yield pa.record_batch(
                [batch.column("id").slice(a, b - a), pa.array(np.diff(first)), pa.array(gone[first[1:]] - gone[first[:-1]]), pa.array([x.decode() for x in whole], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def met_once(rows: DataFrame, *names: str) -> DataFrame:
    """Per text, the places of the names that occur once in the corpus. Counts are summed before the shuffle."""
    counted = rows.groupBy(*names).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("id", "text_key", "place")])
    return counted.filter("n = 1").groupBy("id", "text_key").agg(F.collect_list("place").alias("once"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    place = "id long, text_key long, place"

    def of_text(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        right = right.withColumnRenamed("id", "_id").withColumnRenamed("text_key", "_key")
        joined = left.join(right, left["id"].eqNullSafe(right["_id"]) & (left["text_key"] == right["_key"]), how)
        if how == "full":
            joined = joined.withColumns({"id": F.coalesce("id", "_id"), "text_key": F.coalesce("text_key", "_key")})
        return joined.drop("_id", "_key")

    ranges, left = None, docs.withColumn("ranges", F.lit(None).cast("array<int>"))
    for rounds in LEVELS:
        once = met_once(left.mapInArrow(symbol_rows(rounds), f"name long, {place} long"), "name")
        both = once.withColumn("ranges", F.lit(None).cast("array<int>")) if ranges is None else of_text(ranges, once, "full")
        was, ranges = ranges, scratch.write(both.mapInArrow(window_ranges, "id long, text_key long, ranges array<int>"))
        if was is not None:
            scratch.drop(was)
        scratch.sweep()
        left = of_text(docs, ranges)
    struck = met_once(left.mapInArrow(window_rows, f"name long, more long, {place} int"), "name", "more").withColumnRenamed("once", "struck")
    return of_text(left, struck).mapInArrow(cut_texts, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
