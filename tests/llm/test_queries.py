"""The registered queries on the smallest tables: against DuckDB where SQL can express them, else against brute force."""

from __future__ import annotations

import hashlib
import json
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatterlake.llm import queries as Q

from . import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    frame = Q.QUERIES[name](spark, FOLDER)
    found = duck.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    line = lambda r: json.dumps([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(columns)])
    assert sorted(line(r.asDict()) for r in frame.collect()) == sorted(line(dict(zip(columns, r, strict=True))) for r in found.fetchall())


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op1_minhash_dedup(spark, FOLDER).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.near_components(texts).items()}


def test_packing(spark, texts):
    rows = Q.op2_packing(spark, FOLDER).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*e.ids, 0] for (i, _), e in zip(texts, known.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True)}
    seen = {}
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(w) for i, w in want.items()}
    sequences = len({r.sequence_id for r in rows})
    assert sequences <= 1.02 * sum(seen.values()) / 2048 + 1


def test_classifiers_cover_all_documents(spark, texts):
    ids = [i for i, _ in texts]
    toxic = Q.op4_toxicity(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in toxic) == ids and all(r.predicted == int(r.score >= 0.7) for r in toxic)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in toxic)
    langs = {r.doc_id: r for r in Q.op6_language_id(spark, FOLDER).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    held = [i for i in langs if langs[i].held_out]
    assert sorted(langs) == ids and sum(langs[i].lang_pred == truth[i] for i in held) / len(held) > 0.9


def test_media(spark, texts):
    rows = {r.doc_id: r for r in Q.op8_matroska(spark, FOLDER).collect()}
    for i, t in texts:
        data = (t or "").encode()
        data_padded = data + bytes(-len(data) % 64 if data else 64)
        assert (rows[i].n_bytes, rows[i].payload_sha256) == (len(data), hashlib.sha256(data_padded).hexdigest())


def test_repeated_windows(spark, texts):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in Q.op10_repeated_windows(spark, FOLDER).collect())
    assert got == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute.cut_repeats(texts))
