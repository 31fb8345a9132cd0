from __future__ import annotations

import random

from chatterlake.llm.minhash_dedup import keep_one, near_duplicates

from . import brute


def rows_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def held_against_brute(spark, rows):
    got = rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = {i: (n, c, c == i) for i, (n, c) in brute.near_components(rows).items()}
    assert got == want


def perturbed(base, rng, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base)


def test_groups_of_copies_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "one two three four five six")]
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 300]))]
        rows += [(100 + g * 50 + k, perturbed(base, rng, rng.choice([0, 0.01, 0.03, 0.08]))) for k in range(30)]
    rows.append((5000, "long " + " ".join(f"v{i % 977}" for i in range(60000))))
    held_against_brute(spark, rows)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = rows_of(near_duplicates(docs))
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.near_components(rows).items()}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rep long, component_id long")
    assert near_duplicates(empty).count() == 0
    assert keep_one(empty).columns == ["doc_id", "text", "rep", "component_id"]
    docs = spark.createDataFrame([(2, "a b c d e f", 9, 9), (1, "a b c d e f", 8, 8), (1, "a b c d e f", 7, 7), (3, None, None, None)], "doc_id long, text string, rep long, component_id long")
    assert sorted(r.rep or 0 for r in keep_one(docs).collect()) == [0, 7, 8]
