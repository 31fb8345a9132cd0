from __future__ import annotations

import hashlib
import math

from chatterlake.llm import mixing as M

from . import brute


def brute_mix(rows, labels):
    """(doc_id, size, source_size, target, taken), by the definition."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = sum(sizes.values())
    goal = {s: total * weight[s] / sum(weight.values()) for s in order}
    capped = set()
    while over := [s for s in order if s not in capped and goal[s] > 3 * sizes[s] + 1e-9]:
        capped |= set(over)
        rest = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in rest) for s in order}
    out = []
    for s in order:
        words = math.floor(goal[s] + 0.5)
        epochs = words // sizes[s] if sizes[s] else 0
        rest = words - epochs * sizes[s]
        keyed = []
        for i, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 1) / 2**52
                keyed.append((-math.log(u) / {1: 2.0, 0: 0.5}.get(labels.get(i), 1.0), i, len(brute.words(t))))
        for _, i, n in sorted(keyed):
            out.append((i, n, sizes[s], round(goal[s], 6), epochs * n + max(0, min(n, rest))))
            rest -= n
    return sorted(out)


def test_matches_definition(spark):
    rows = [(i, "w " * (i * 37 % 101), ["a", "b", "c", "é", None, "tiny"][(i * i) % 6 if i % 3 else 0]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "one", "tiny2"), (1002, None, "none"), (1003, "x " * 30_000, "b")]
    labels = {i: i % 2 for i in range(0, 400, 3)}
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    marks = spark.createDataFrame([*labels.items(), (5, None)], "doc_id long, quality int")
    got = M.mix(docs, marks).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(rows, labels)
    assert all(r.taken <= 3 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 0.5 for taken, target in per.values())


def test_documents_of_the_mix(spark):
    rows = [(i, f"w{i} " * 10, "a" if i < 10 else "b", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs int")
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert [ids.count(i) for i in range(10)] == [3] * 10 and len(ids) - 30 == 70


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).count() == 0 and M.mixed_documents(docs).count() == 0
    same = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    got = M.mix(same).collect()
    assert sorted(r.taken for r in got) == [0, 2, 2, 2]


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST", 10)
    rows = [(i, "w " * (i % 23), f"s{i % 60}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `_Key` int")
    got = M.mix(docs).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix([r[:3] for r in rows], {})
    assert M.mixed_documents(docs).columns == docs.columns
