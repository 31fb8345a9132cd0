from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from chatterlake.llm import language_id as X


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    h = X.HIDDEN
    shapes = {"table_f": (256, 3 * h), "turn_f": (3 * h, h), "table_b": (256, 3 * h), "turn_b": (3 * h, h), "out": (3, 2 * h), "bias": (3,)}
    a = {k: rng.normal(size=s) * 0.4 for k, s in shapes.items()}
    rows, length, _ = X.pieces_of(pa.array(["the quick brown fox", "é" * 90, "ab" * 64]))
    truth = np.array([0, 2, 1, 1])[: len(rows)]
    _, grads = X.gradients(a, rows, length, truth)
    for name, at in (("table_f", (ord("q"), 5)), ("table_b", (ord("a"), 2 * h + 3)), ("turn_f", (h + 2, 4)), ("turn_b", (2 * h + 1, 7)), ("out", (1, h + 3)), ("bias", (2,))):
        losses = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in a.items()}
            moved[name][at] += step
            losses.append(X.gradients(moved, rows, length, truth)[0])
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at])


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(2)
    stems = {"xx": ["thon", "ering", "the", "shan"], "yy": ["keit", "ung", "über", "sch"], "zz": ["ción", "llor", "que", "ñam"]}
    docs = []
    for i in range(400):
        lang = rng.choice(list(stems))
        docs.append((i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(rng.randrange(8, 80))), lang))
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 -- 4!", "yy"), (1003, "thering " * 60_000, None), (None, "keitung über schkeit", "yy")]
    frame = spark.createDataFrame([(*d, 0.0) for d in docs + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in X.language_id(frame).collect()}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = {i: lang for i, _, lang in docs}
    assert len(held) > 50 and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "xx" and got[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in X.language_id(docs).collect()] == [("und", 0.0)] * 2
    one = spark.createDataFrame([(i, "abc", "qq") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in X.language_id(one).collect()} == {("qq", 1.0)}
    assert X.language_id(docs.limit(0)).count() == 0


def plain_probabilities(model, text):
    """Both passes, byte by byte and unit by unit, afresh in each piece."""
    a, h = {k: v.astype(float) for k, v in model.arrays.items()}, X.HIDDEN
    raw = text.encode()
    sums = [0.0] * len(model.languages)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def states(data, table, turn):
        state, out = [0.0] * h, []
        for byte in data:
            x = table[byte]
            g = [sum(turn[r][c] * state[c] for c in range(h)) for r in range(3 * h)]
            fresh = [np.tanh(x[2 * h + k] + sigmoid(x[k] + g[k]) * g[2 * h + k]) for k in range(h)]
            state = [state[k] + sigmoid(x[h + k] + g[h + k]) * (fresh[k] - state[k]) for k in range(h)]
            out.append(state)
        return out

    for at in range(0, len(raw), X.PIECE):
        piece = raw[at : at + X.PIECE]
        padded = piece + bytes(X.PIECE - len(piece))  # the backward pass begins behind the end, on zeros
        forth, behind = states(piece, a["table_f"], a["turn_f"]), states(padded[::-1], a["table_b"], a["turn_b"])[::-1]
        for f, b in zip(forth, behind):
            z = [a["bias"][k] + sum(a["out"][k][c] * v for c, v in enumerate([*f, *b])) for k in range(len(sums))]
            e = [np.exp(v - max(z)) for v in z]
            sums = [s + v / sum(e) for s, v in zip(sums, e)]
    return [s / len(raw) for s in sums]


def test_probabilities_match_a_plain_network():
    texts = ["thering shan über", "ü" * 70, "ab" * 64, "x"]
    model = X.fit(pa.array(["the cat sat " * 20, "über keit ung " * 20, "que ción " * 30]), ["aa", "bb", "cc"], steps=30)
    got = X.document_probabilities(model, pa.array(texts))
    for row, text in zip(got, texts):
        assert max(abs(x - y) for x, y in zip(row, plain_probabilities(model, text))) < 1e-5
