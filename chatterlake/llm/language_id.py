"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position of a text gets a probability for each language from the states of a
forward and a backward pass around it; a document's probabilities are the means over all
its positions. Texts are read whole, in pieces of `PIECE` bytes whose passes start afresh,
so that thousands of pieces go through one matrix product at a time.

Trained here in numpy by backpropagation through time, on a bounded sample: at most
`SAMPLE` rows, those with the smallest hashes of their ids, of texts of at most
`SAMPLE_BYTES` bytes, and at most `PIECES` pieces of each.

Defined cases. A null text, or one without a letter, is `und` with score 0; so is every
text if no language could be learned. A single learned language has score 1. A very long
text is read whole, `WIDE` pieces at a time. Rows that repeat a doc_id are read each; a null
doc_id is not held out and stays null. Equal probabilities go to the first language by name.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T

SAMPLE, SAMPLE_BYTES, PIECES = 3_000, 32_768, 4
PIECE, HIDDEN, BATCH, STEPS, RATE = 128, 12, 256, 240, 0.01
#: Pieces that go through the network at once when scoring.
WIDE = 2048
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    arrays: dict[str, np.ndarray]


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the pieces (one a row, zeros after a text's end), their lengths, and the texts that own them."""
    raw, offsets = T.text_buffer(texts)
    size = np.diff(offsets)
    count = -(-size // PIECE)
    owner = np.repeat(np.arange(len(size)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    start = offsets[:-1][owner] + (np.arange(begin[-1]) - begin[owner]) * PIECE
    length = np.minimum(offsets[1:][owner] - start, PIECE)
    rows = np.zeros((len(owner), PIECE), np.uint8)
    inside = np.arange(PIECE) < length[:, None]
    rows[inside] = raw  # pieces are in the order of the buffer
    return rows, length, owner


def run(steps: np.ndarray, table: np.ndarray, turn: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """The states (hidden x batch) after each step; steps: bytes, one row a step. keep gathers what training needs."""
    h_size = turn.shape[1]
    h = np.zeros((h_size, steps.shape[1]), np.float32)
    for row in steps:
        x = np.ascontiguousarray(table[row].T)
        g = turn @ h
        gates = x[: 2 * h_size] + g[: 2 * h_size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        reset, update = gates[:h_size], gates[h_size:]
        fresh = reset * g[2 * h_size :]
        fresh += x[2 * h_size :]
        np.tanh(fresh, out=fresh)
        if keep is not None:
            keep.append((h, g[2 * h_size :], reset, update, fresh))
        h = h + update * (fresh - h)
        yield h


def back(steps: np.ndarray, turn: np.ndarray, kept: list, pushes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent weights; pushes: the loss's gradient at each state."""
    h_size = turn.shape[1]
    d_turn, d_rows, d_h = np.zeros_like(turn), np.empty((len(steps), 3 * h_size, steps.shape[1]), np.float32), 0
    for k in range(len(steps) - 1, -1, -1):
        was, g, reset, update, fresh = kept[k]
        d_h = d_h + pushes[k]
        d_fresh = d_h * update * (1 - fresh * fresh)
        d_reset = d_fresh * g * reset * (1 - reset)
        d_update = d_h * (fresh - was) * update * (1 - update)
        d_rows[k] = np.concatenate([d_reset, d_update, d_fresh])
        d_gates = np.concatenate([d_reset, d_update, d_fresh * reset])
        d_turn += d_gates @ was.T
        d_h = d_h * (1 - update) + turn.T @ d_gates
    flat, byte = d_rows.transpose(1, 0, 2).reshape(3 * h_size, -1), steps.ravel()
    return np.stack([np.bincount(byte, row, minlength=256) for row in flat], axis=1).astype(np.float32), d_turn


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=0))
    return x / x.sum(axis=0)


def gradients(a: dict, rows: np.ndarray, length: np.ndarray, truth: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all positions, and its gradients."""
    steps = np.ascontiguousarray(rows.T)
    kept_f: list = []
    kept_b: list = []
    forth = np.stack(list(run(steps, a["table_f"], a["turn_f"], kept_f)))
    behind = np.stack(list(run(steps[::-1], a["table_b"], a["turn_b"], kept_b)))[::-1]
    states = np.concatenate([forth, behind], axis=1)  # step x 2H x batch
    logits = np.matmul(a["out"], states) + a["bias"][:, None]
    p = softmax(logits.transpose(1, 0, 2))  # language x step x batch
    weight = (np.arange(PIECE)[:, None] < length) / length.sum()
    chosen = np.take_along_axis(p, np.broadcast_to(truth, (1, *p.shape[1:])), axis=0)[0]
    loss = float(-(np.log(chosen + 1e-12) * weight).sum())
    d = p * weight
    np.put_along_axis(d, np.broadcast_to(truth, (1, *p.shape[1:])), (chosen - 1)[None] * weight, axis=0)
    d = d.transpose(1, 0, 2).astype(np.float32)
    push = np.matmul(a["out"].T, d)
    table_f, turn_f = back(steps, a["turn_f"], kept_f, push[:, :HIDDEN])
    table_b, turn_b = back(steps[::-1], a["turn_b"], kept_b, push[::-1, HIDDEN:])
    out = np.tensordot(d, states, axes=([0, 2], [0, 2]))
    return loss, {"table_f": table_f, "turn_f": turn_f, "table_b": table_b, "turn_b": turn_b, "out": out, "bias": d.sum(axis=(0, 2))}


def fit(texts: pa.Array, truth: list[str], steps: int = STEPS) -> Model:
    """Adam over batches of random pieces."""
    languages = sorted(set(truth))
    rng = np.random.default_rng(6)
    n, h = len(languages), HIDDEN
    shapes = {"table_f": (256, 3 * h), "turn_f": (3 * h, h), "table_b": (256, 3 * h), "turn_b": (3 * h, h), "out": (n, 2 * h), "bias": (n,)}
    a = {k: (rng.normal(size=s) * (0 if k == "bias" else 0.3)).astype(np.float32) for k, s in shapes.items()}
    rows, length, owner = pieces_of(texts)
    order = rng.permutation(len(owner))  # at most PIECES of each text
    place = np.empty(len(order), np.int64)
    by_text = order[np.argsort(owner[order], kind="stable")]
    place[by_text] = np.arange(len(order)) - np.searchsorted(owner[by_text], owner[by_text])
    use = place < PIECES
    rows, length, label = rows[use], length[use], np.searchsorted(languages, truth)[owner[use]]
    if n < 2 or not len(rows):
        return Model(languages, a)
    mean, spread = ({k: np.zeros_like(v) for k, v in a.items()} for _ in range(2))
    for turn in range(1, steps + 1):
        at = rng.integers(0, len(rows), min(BATCH, len(rows)))
        _, grads = gradients(a, rows[at], length[at], label[at])
        rate = RATE * min(1, 3 * (1 - (turn - 1) / steps))
        scale = min(1.0, 1 / (1e-12 + np.sqrt(sum(float((g**2).sum()) for g in grads.values()))))
        for k, g in grads.items():
            g = g * np.float32(scale)
            mean[k] += 0.1 * (g - mean[k])
            spread[k] += 0.01 * (g * g - spread[k])
            a[k] -= (rate * mean[k] / (1 - 0.9**turn) / (np.sqrt(spread[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return Model(languages, a)


def piece_probabilities(a: dict, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over a piece's positions of each language's probability (language x piece)."""
    steps = np.ascontiguousarray(rows.T)
    forth = list(run(steps, a["table_f"], a["turn_f"]))
    out_f, out_b = a["out"][:, :HIDDEN], a["out"][:, HIDDEN:]
    total = np.zeros((len(a["bias"]), len(rows)), np.float32)
    for k, h in zip(range(PIECE - 1, -1, -1), run(steps[::-1], a["table_b"], a["turn_b"]), strict=True):
        p = out_f @ forth[k] + out_b @ h + a["bias"][:, None]
        np.exp(p - p.max(axis=0), out=p)
        p *= (length > k) / p.sum(axis=0)
        total += p
    return total


def document_probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """Text x language: means over all positions of the whole text; zeros for an empty one."""
    rows, length, owner = pieces_of(texts)
    sums = np.zeros((len(texts), len(model.languages)))
    for a in range(0, len(rows), WIDE):
        total = piece_probabilities(model.arrays, rows[a : a + WIDE], length[a : a + WIDE])
        for k, row in enumerate(total):
            sums[:, k] += np.bincount(owner[a : a + WIDE], row, minlength=len(texts))
    return sums / np.maximum(np.bincount(owner, length, minlength=len(texts)), 1)[:, None]


def train(docs: DataFrame, usable: Column | None = None, limit: int = SAMPLE) -> Model:
    """Fits on at most `limit` rows with a language; usable: a condition on doc_id."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null").filter(F.octet_length("text") <= SAMPLE_BYTES)
    if usable is not None:
        known = known.filter(usable)
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_id")
    rows = known.join(F.broadcast(chosen), known["doc_id"] == F.col("_id")).select("doc_id", "text", "lang")
    # Rows may repeat an id: they are bounded once more, in the same order.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text")).limit(limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())]))
        sample = sample.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")]).combine_chunks()
        if len(sample):
            found = fit(sample["text"].combine_chunks(), sample["lang"].to_pylist())
            yield pa.record_batch([pa.array([pickle.dumps((found.languages, found.arrays))])], names=["model"])

    # The sample is bounded, so it is fitted in one task; only the model comes to the driver.
    found = rows.select(F.col("doc_id").cast("long"), "text", "lang").repartition(1).mapInArrow(work, "model binary").collect()
    return Model(*pickle.loads(found[0]["model"])) if found else Model([], {})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts, lettered = batch.column("text"), batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in T.slices(texts):
                p = document_probabilities(model, texts.slice(a, b - a)) if model.languages else np.zeros((b - a, 1))
                some = lettered[a:b] & bool(model.languages)
                best = np.where(some, p.argmax(axis=1), len(model.languages))
                score = np.where(some, np.minimum(p.max(axis=1), 1), 0)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns only from ids that aren't held out."""
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(docs, train(docs, ~apart))
    return found.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "lang_pred", "score")
