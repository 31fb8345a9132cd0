from __future__ import annotations

import hashlib
import random

from chatterlake.llm.repeated_windows import remove_repeats

from . import brute


def held_against_brute(frame, rows):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in frame.collect())
    want = sorted((*x, hashlib.sha256(x[3].encode()).hexdigest()) for x in brute.cut_repeats(rows))
    assert got == want


def test_planted_passages_runs_and_edges(spark):
    rng = random.Random(9)
    word = lambda: f"é{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 200)]
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "a " * 34), (5, "b " * 36), (6, "b " * 90), (7, "x y " * 40), (8, "z " * 35), (8, "other text")]
    rows += [(9, "same id " + " ".join(map(str, range(60)))), (9, "same id " + " ".join(map(str, range(60))))]
    for i in range(40):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = p
        rows.append((100 + i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows.append((500, " ".join(f"v{i % 40000}" for i in range(60000))))
    held_against_brute(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_against_brute(remove_repeats(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table_null_id_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id long, ranges string")
    assert remove_repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, 1, "a"), (5, text + " tail", 1, "a"), (None, "short", 1, None)], "doc_id long, text string, id long, ranges string")
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in remove_repeats(docs).collect()}
    assert got == {(None, 40): (40, ""), (5, 41): (40, "tail"), (None, 1): (0, "short")}


def test_copies_beside_their_own_edge_word(spark):
    rng = random.Random(3)
    rows = []
    for k in range(4000):
        p = [f"p{k}_{i}" for i in range(35 + k % 3)]
        side = [f"{x}{k}_{rng.randrange(9)}" for x in ("u", "v")]
        rows.append((2 * k, " ".join([side[0], *p, side[1]])))
        rows.append((2 * k + 1, " ".join([side[1], *p, p[-1], "t"] if k % 2 else ["t", p[0], *p, side[0]])))
    held_against_brute(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), rows)
