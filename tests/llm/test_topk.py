from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from chatterlake.llm import topk as M

SCHEMA = "vec_id long, embedding array<double>, rank int, low string"


def brute(rows, k=5):
    """Every row of a query id against every row of another id; scores beyond M.MOST count as that."""
    good = [(i, [math.floor(min(max(x * 256, -1e300), 1e300)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % 50 == 0}:
        scored = sorted((-max(-M.MOST, min(M.MOST, sum(a * b for a, b in zip(u, v)))), i) for j, u in good if j == q for i, v in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in M.top_k(frame, F.col("vec_id") % 50 == 0).collect())


def test_random_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(200)]  # one common vector
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, []), (705, [2.0] * 3), (None, [1.0] * 8), (7, [9.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e5, 3.0])] + [(i, [1e5 + i / 256, 1 / 256 * (i % 3)]) for i in range(1, 40)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(50, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_rows_that_share_an_id_all_count(spark):
    rows = [(0, [1.0]), (0, [-2.0]), (1, [2.0]), (1, [3.0]), (2, [1.0]), (2, [1.0]), (50, [0.5])]
    assert run(spark, rows) == brute(rows) and (0, 1, 1, 196608) in run(spark, [(0, [1.0]), (1, [2.0]), (1, [3.0])])
    hot = [(7, [float(i % 9), 1.0]) for i in range(300)] + [(i, [1.0, float(i % 5)]) for i in range(100, 160)]
    assert run(spark, hot) == brute(hot)


def test_large_finite_components(spark):
    rows = [(0, [1e9] * 16), (1, [1e9] * 16), (2, [-1e9] * 16), (3, [1e300] * 16), (4, [1.0] * 16), (5, [1e308] + [0.0] * 15)] + [(50 + i, [i / 7.0] * 16) for i in range(30)]
    assert run(spark, rows) == brute(rows)
