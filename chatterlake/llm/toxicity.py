"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's log-odds is a bias plus the weights of its words and of their beginnings (so
that inflected and compound forms count); a document is toxic if one of its sentences is:
P = 1 - prod(1 - p), the noisy-or. Training sees document labels
only; the same sentence scores then say where the offence is.

The training sample is bounded: at most `SAMPLE` labelled rows, those with the smallest
hashes of their ids, of texts of at most `SAMPLE_BYTES` bytes. A word or beginning needs `MIN_DOCS` documents, and one in
`DOCS_SHARE`, to get a weight. Weights are evidence for toxicity and never negative: no
harmless sentence around an offence can hide it.

Defined cases. A null or empty text, or one without words, has no sentence: score 0.
A label row that repeats a doc_id counts once, the larger label holding; null labels are
left out. Without labels of both kinds no word has a weight, and every sentence gets the
bias of `NO_MODEL`. A very long text is scored whole, a few megabytes of sentences at a
time or alone. Rows that repeat a doc_id are scored each; a null doc_id is not held out and
stays null. Ties of ids in the sample go by the texts' hashes. An empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .storage import fresh

SAMPLE, MIN_DOCS, DOCS_SHARE, EPOCHS, RATE, SHRINK = 8_000, 3, 500, 120, 0.3, 0.01
#: Bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5)
NO_MODEL = -8.0
THRESHOLD = 0.7
#: Bytes of a text that may be in the training sample.
SAMPLE_BYTES = 32_768
#: A feature's odds of toxic documents must be so many times the corpus's.
LIFT = 3.0
#: Hashes whose low bits no feature of the model has are not looked up.
MASK = (1 << 16) - 1

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
INK = np.zeros(256, bool)
INK[48:58] = INK[65:91] = INK[97:123] = INK[128:] = True
#: Bytes that end a sentence: full stop, exclamation and question mark, line feed.
STOP = np.zeros(256, bool)
STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True


@dataclass
class Model:
    words: np.ndarray  # hashes, sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.possible = np.zeros(MASK + 1, bool)
        self.possible[(self.words & T.U64(MASK)).astype(np.int64)] = True

    def of(self, features: np.ndarray) -> np.ndarray:
        """The weight of each feature, 0 if it has none: an exact search among the model's."""
        out = np.zeros(features.shape, np.float32)
        at = np.nonzero(self.possible[(features & T.U64(MASK)).astype(np.int64)])
        held = features[at]
        place = np.minimum(np.searchsorted(self.words, held), max(len(self.words) - 1, 0))
        if len(self.words):
            out[at] = np.where(self.words[place] == held, self.weights[place], np.float32(0))
        return out


@dataclass
class Sentences:
    """Features of a batch, by word, with the sentences and texts that hold them; sentences without words don't count."""

    words: np.ndarray  # a row for each word: its hash and its beginnings', 0 where the word is no longer
    begin: np.ndarray  # each sentence's first word
    doc: np.ndarray  # each sentence's text
    start: np.ndarray  # each sentence's bytes, from its first word
    end: np.ndarray  # to its last


def sentences_of(texts: pa.Array) -> Sentences:
    raw, offsets = T.text_buffer(texts)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return Sentences(np.zeros((0, 1 + len(BEGINNINGS)), T.U64), none, none, none, none)
    raw = T.LOWER[raw]
    ink = INK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(starts):
        return Sentences(np.zeros((0, 1 + len(BEGINNINGS)), T.U64), none, none, none, none)
    words = np.zeros((len(starts), 1 + len(BEGINNINGS)), T.U64)
    words[:, 0] = T.word_hashes(raw, starts, ends)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts > n)
        words[longer, k] = T.word_hashes(raw, starts[longer], starts[longer] + n)
    passed = np.cumsum(STOP[raw] | edge[:-1])[starts]
    begin = np.flatnonzero(np.concatenate([[True], passed[1:] != passed[:-1]]))
    doc = np.searchsorted(offsets, starts[begin], side="right") - 1
    return Sentences(words, begin, doc, starts[begin], ends[np.append(begin[1:], len(starts)) - 1])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    found, place = np.unique(keys, return_inverse=True)
    return [found, *[np.bincount(place, c, minlength=len(found)).astype(np.int64) for c in counts]]


def screened(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Hashes of the features in enough documents, toxic ones above their share. Others can't earn a weight above 0."""
    have = [np.zeros(0, T.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for a, b in T.slices(texts):
        s = sentences_of(texts.slice(a, b - a))
        sizes = np.diff(np.append(s.begin, len(s.words)))
        features, owner, _ = T.distinct(s.words.ravel(), np.repeat(np.repeat(s.doc, sizes), s.words.shape[1]))
        toxic = labels[a:b][owner].astype(np.int64) if len(owner) else np.zeros(0, np.int64)
        have = summed(*[np.concatenate([x, y]) for x, y in zip(have, (features, np.ones(len(features), np.int64), toxic), strict=True)])
    keys, docs, toxic = have
    enough = (docs >= max(MIN_DOCS, len(labels) // DOCS_SHARE)) & (keys != 0)
    return keys[enough & (toxic * float((~labels).sum()) > LIFT * labels.sum() * (docs - toxic))]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Adam on the documents' log loss, all documents in each step."""
    labels = labels.astype(bool)
    if not labels.any() or labels.all():
        return Model(np.zeros(0, T.U64), np.zeros(0, np.float32), NO_MODEL)
    vocabulary = screened(texts, labels)
    if not len(vocabulary):
        return Model(np.zeros(0, T.U64), np.zeros(0, np.float32), NO_MODEL)
    slots, owners, doc, count = [], [], [], 0
    for a, b in T.slices(texts):
        s = sentences_of(texts.slice(a, b - a))
        sizes = np.diff(np.append(s.begin, len(s.words)))
        place = np.minimum(np.searchsorted(vocabulary, s.words), len(vocabulary) - 1)
        word, k = np.nonzero(vocabulary[place] == s.words)
        slots.append(place[word, k].astype(np.int32))
        owners.append((np.repeat(np.arange(len(sizes)), sizes)[word] + count).astype(np.int32))
        doc.append(s.doc + a)
        count += len(sizes)
    slot, owner, doc = np.concatenate(slots), np.concatenate(owners), np.concatenate(doc)
    n = len(vocabulary)
    weights, bias = np.zeros(n), -np.log(max(1, count) / labels.sum())
    mean, spread = np.zeros(n + 1), np.zeros(n + 1)
    balance = np.where(labels, 0.5 / labels.mean(), 0.5 / (~labels).mean()) ** 0.5
    for turn in range(1, EPOCHS + 1):
        z = np.bincount(owner, weights[slot], minlength=count) + bias
        total = np.bincount(doc, softplus(z), minlength=len(labels))  # -log(1 - P)
        pull = np.where(labels, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-12), 1.0) * balance
        step = pull[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
        grad = np.append(np.bincount(slot, step[owner], minlength=n) + SHRINK * weights, step.sum()) / len(labels)
        mean += 0.1 * (grad - mean)
        spread += 0.01 * (grad**2 - spread)
        move = RATE * mean / (1 - 0.9**turn) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        weights = np.maximum(weights - move[:-1], 0)
        bias -= move[-1]
    return Model(vocabulary, weights.astype(np.float32), float(bias))


def log_odds(s: Sentences, model: Model) -> np.ndarray:
    return np.add.reduceat(model.of(s.words).sum(axis=1, dtype=np.float64), s.begin) + model.bias if len(s.begin) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, usable=None, limit: int = SAMPLE) -> Model:
    """Fits on at most `limit` labelled rows; usable: a condition on doc_id that they must meet."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if usable is not None:
        known = known.filter(usable)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_id")
    docs = docs.select("doc_id", "text")
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # Rows may repeat an id: they are bounded once more, in the same order.
    rows = rows.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int64())]))
        sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        texts = sample["text"].combine_chunks() if len(sample) else pa.array([], pa.string())
        found = fit(texts, sample["toxic"].to_numpy() == 1)
        yield pa.record_batch([pa.array([found.words.tobytes()]), pa.array([found.weights.tobytes()]), pa.array([found.bias])], names=["words", "weights", "bias"])

    # The sample is bounded, so it is fitted in one task; only the model comes to the driver.
    sample = rows.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("long").alias("toxic")).repartition(1)
    found = sample.mapInArrow(work, "words binary, weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(0, T.U64), np.zeros(0, np.float32), NO_MODEL)
    return Model(np.frombuffer(found[0]["words"], T.U64), np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in T.slices(texts):
                s = sentences_of(texts.slice(a, b - a))
                total = np.bincount(s.doc, softplus(log_odds(s, model)), minlength=b - a)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(-np.expm1(-total))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def locate_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences with a score of at least `least`: doc_id, sentence (from 0), its text and score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in T.slices(texts):
                part = texts.slice(a, b - a)
                s = sentences_of(part)
                p = 1 / (1 + np.exp(-np.clip(log_odds(s, model), -60, 60)))
                hot = np.flatnonzero(p >= least)
                data = T.text_buffer(part)[0].tobytes()
                first = np.searchsorted(s.doc, s.doc[hot])
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(s.doc[hot] + a)), pa.array(hot - first), pa.array([data[s.start[k] : s.end[k]].decode() for k in hot], pa.string()), pa.array(p[hot])],
                    names=["doc_id", "sentence", "sentence_text", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, sentence long, sentence_text string, score double")


def held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns only from ids that aren't held out."""
    model = train(docs, labels, ~held_out(3, 1))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, all their columns unchanged; rows without a doc_id stay."""
    (name,) = fresh(docs, "id")
    bad = toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[name], "left_anti")
