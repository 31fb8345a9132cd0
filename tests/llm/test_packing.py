from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatterlake.llm import packing as P
from chatterlake.llm import queries


def expanded(counts, runs):
    """sequence -> sorted (offset, length), from the runs."""
    out = {}
    for length, n in counts.items():
        mine = runs[runs[:, 0] == length]
        for rank in range(n):
            _, low, many, sequence, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            out.setdefault(sequence + (rank - low) // many, []).append((offset + (rank - low) % many * length, length))
    return {k: sorted(v) for k, v in out.items()}


def gapless(sequences, capacity):
    for pieces in sequences.values():
        at = 0
        for offset, length in pieces:
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=14))))
def test_plan_places_each_piece_once(case):
    capacity, counts = case
    runs, n = P.plan(counts, capacity)
    sequences = expanded(counts, runs)
    gapless(sequences, capacity)
    assert len(sequences) == n and sum(len(v) for v in sequences.values()) == sum(counts.values())


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0] and k < len(lengths):
            return
        if k == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_plan_is_close_to_the_optimum():
    rng, more = random.Random(4), 0
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        least = fewest(lengths, capacity)
        got = P.plan(counts, capacity)[1]
        assert least <= got <= least + 1
        more += got - least
    assert more <= 3


def test_reduction_fixes_dominant_sets():
    assert P.dominating(P.Stock({40: 1, 30: 2}), 60, 100) == [40]  # fills it
    assert P.dominating(P.Stock({35: 1, 20: 3}), 62, 100) == [35]  # no room for two
    assert P.dominating(P.Stock({21: 1, 15: 2}), 62, 100) == [21, 15]  # no room for three, no better second
    assert P.dominating(P.Stock({30: 1, 5: 9}), 62, 100) is None
    assert P.dominating(P.Stock({50: 1}), 62, 100) == []


def test_pieces_and_checksums_match_the_tokenizer(spark):
    rng = random.Random(0)
    texts = [(1, None), (2, ""), (3, "hi"), (3, "hi"), (4, "long " * 9000), (5, "é<|endoftext|> x" * 40), (None, "no id")]
    texts += [(100 + i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(2500)))) for i in range(60)]
    docs = spark.createDataFrame([(*t, 0, "") for t in texts], "doc_id long, text string, length int, sequence_id string")
    rows = P.pack(docs).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, p, x, y - x, zlib.crc32(ids[x:y].tobytes())) for p, (x, y) in enumerate(zip(at, at[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless({k: sorted(v) for k, v in sequences.items()}, 2048)
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 2048
    assert P.pack(docs.limit(0)).count() == 0


def test_added_tokens_are_found_in_texts(spark, tmp_path):
    texts = ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", " a\n<|endoftext|>  b", "<|endoftext", "é<|endoftext|> x" * 900, "'s<|endoftext|>'s"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = P.cuts(len(ids), 2048)
        want += [(i, p, x, y - x, zlib.crc32(ids[x:y].tobytes())) for p, (x, y) in enumerate(zip(at, at[1:]))]
    assert sorted(tuple(r)[:5] for r in queries.op2_packing(spark, str(tmp_path)).collect()) == want


def test_very_long_texts_and_the_end_token(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, "x <|endoftext|> y", "a" * 250_000 + " <|endoftext|>", "word " * 60_000, None, ""]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "null id", 1, 2)], "doc_id long, text string, length int, salt int")
    got = {}
    for r in P.pack(frame).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in [*enumerate(texts), (None, "null id")]:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = P.cuts(len(ids), P.CAPACITY)
        assert sorted(got[i]) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
