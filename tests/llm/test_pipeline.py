from __future__ import annotations

import corpus_pipeline as P
from chatterlake.llm import minhash_dedup, toxicity

from . import brute
from .test_line_dedup import want

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_does_what_brute_force_says(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in P.STAGES:
        out = stage(spark, frames[-1], FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:-1]]

    predicted = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("predicted = 1").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] not in predicted)
    assert dict(rows[2]) == {i: k for i, (_, _, k) in want(rows[1]).items()}
    components = brute.near_components(rows[2])
    assert sorted(rows[3]) == sorted(r for r in rows[2] if components[r[0]][1] == r[0])
    assert set(rows[4]) <= set(rows[3]) and max(rows[4].count(r) for r in set(rows[4])) <= 3
    before = sum(len(brute.words(t)) for _, t in rows[3])
    assert abs(sum(len(brute.words(t)) for _, t in rows[4]) - before) / before < 0.1
    packed = frames[5].collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(i for i, _ in rows[4])
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
    assert minhash_dedup.keep_one(docs).count() == 0


def test_stages_on_odd_rows_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base, "a"), (2, base + " tail", "a"), (3, None, None), (4, "", "b"), (None, "no id here at all", "b"), (None, None, None), (5, f"{base}\n{base}\nown line", "b"), (6, "x " * 20_000, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, _id int, _key int, `ID` int, copies int, _copy int, `Gone` int, stays int"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t, s in rows], schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), schema)
    assert 0 < docs.count()
    pieces = P.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.filter("piece = 0").count() == docs.count()
