from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np

from chatterlake.llm import textkit
from chatterlake.llm import toxicity as X


def corpus(n, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 15))) for _ in range(rng.randrange(1, 20))]
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["scum", "GRUBER" + rng.choice("abcdef") * 3])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_located_sentences(spark):
    docs, labels = corpus(900)
    docs += [(10_000, None), (10_001, ""), (10_002, " .!? "), (10_003, "clean " * 100_000 + "scum")]
    frame = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, predicted string")
    marks = spark.createDataFrame([(*x, 0) for x in labels] + [(3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in X.toxicity(frame, marks).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == len(docs) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert got[10_000].score == got[10_001].score == got[10_002].score == 0 and got[10_003].predicted == 1
    model = X.train(frame, marks, ~X.held_out(3, 1))
    for r in X.locate_sentences(frame, model).filter("doc_id < 900").collect():
        assert "scum" in r.sentence_text or "GRUBER" in r.sentence_text
    stay = {r.doc_id for r in X.drop_toxic(frame, marks).collect()}
    assert stay == {i for i in got if not got[i].predicted}


def test_no_labels_one_kind_of_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (None, 1), (2, None)]):
        marks = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = X.toxicity(docs, marks).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
        assert X.drop_toxic(docs, marks).count() == 3
    assert X.toxicity(docs.limit(0), marks).count() == 0


def plain_score(text, model):
    """Noisy-or by loops over sentences, words and their beginnings."""
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))

    def name(word):
        return int(textkit.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    clean = 1.0
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    for sentence in re.split(rb"[.!?\n]", lowered):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
        if words:
            z = model.bias + sum(weight.get(name(x), 0.0) for w in words for x in (w, *[w[:n] for n in X.BEGINNINGS if len(w) > n]))
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_match_a_plain_scorer(spark):
    docs, labels = corpus(300, seed=8)
    docs += [(9_000, None), (9_001, "Scum! scum? GRUBERaaa\nÜber scum"), (9_002, "...")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, `_ID` int")
    model = X.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.words) > 0
    got = {r.doc_id: r.score for r in X.score_documents(frame, model).collect()}
    assert all(abs(got[i] - plain_score(t, model)) < 1e-5 for i, t in docs)
    assert X.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).columns == frame.columns


def test_held_out_quality_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    found = X.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.toxic is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in found.filter("held_out").collect() if r.doc_id in truth]
    bad = [p for p, t in held if t == 1]
    clean = [p for p, t in held if t == 0]
    assert len(bad) > 100 and sum(bad) / len(bad) > 0.8 and sum(clean) / len(clean) < 0.01


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"scum {i}") for i in range(50)] + [(2, "fine")], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), limit=10)
    assert model.bias <= 0
