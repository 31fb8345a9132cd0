from __future__ import annotations

import hashlib
import random
from collections import Counter

from chatterlake.llm import line_dedup as L

from . import brute


SCHEMA = "doc_id long, text string, n_chars long, line string, c int, _id int, _key int, `Gone` int"


def want(rows):
    """doc_id -> (n_lines, n_removed, kept text), comparing every line with every earlier one."""
    earlier, out = [], {}
    for i, t in sorted(rows):
        kept, gone = [], 0
        for line in t.split("\n") if t is not None else []:
            s = set(brute.words(line))
            if s and any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                gone += 1
            else:
                kept.append(line)
            if s:
                earlier.append(s)
        out[i] = (len(kept) + gone, gone, "\n".join(kept))
    return out


def held_against_brute(spark, rows):
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", 1, 1, 1, 1) for i, t in rows], SCHEMA)
    expected = want([(i, t) for i, t in rows if t is not None]) | {i: (0, 0, "") for i, t in rows if t is None}
    got = {r.doc_id: tuple(r)[1:] for r in L.report(docs).collect()}
    assert got == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in expected.items()}
    left = L.without_repeats(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        assert (r.text or "") == expected[r.doc_id][2] and r.n_chars == len(r.text or "")


def test_groups_of_similar_lines_and_edges(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60]))] for _ in range(25)]
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "same\nsame\n same \nother"), (5, "tab\tone two  three"), (6, "three two one tab")]
    for i in range(10, 80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = [w if rng.random() > 0.08 else f"n{rng.randrange(10**6)}" for w in rng.choice(bases)]
            rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    rows.append((900, " ".join(f"v{i}" for i in range(30_000)) + "\n" + " ".join(f"v{i}" for i in range(2_000, 30_000))))
    held_against_brute(spark, rows)


def test_frequent_tokens_are_listed_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 3)
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 20]))] for _ in range(15)]
    rows = []
    for i in range(60):
        words = [w if rng.random() > 0.1 else f"n{rng.randrange(30)}" for w in rng.choice(bases)]
        rows.append((i, "\n".join([" ".join(words), f"n{i % 7}", f" n{i % 7}\t"])))
    held_against_brute(spark, rows)


def test_filters_lose_no_pair_of_the_threshold(spark):
    a = [f"t{i}" for i in range(12)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:9])), (3, " ".join([*a, "x", "y", "z", "q"])), (4, " ".join([*a[:6], "u", "v"])), (5, " ".join(a[:8]))]
    held_against_brute(spark, rows)


def test_rows_alike_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two\none two", 1, "x", 1, 1, 1, 1), (7, "one two\nmore", 1, "x", 1, 1, 1, 1), (7, "one two\nmore", 1, "x", 1, 1, 1, 1), (7, "more", 1, "x", 1, 1, 1, 1)], SCHEMA)
    got = sorted((str(r.doc_id), r.text) for r in L.without_repeats(docs).collect())
    assert got == [("7", ""), ("7", ""), ("7", "more"), ("None", "one two")]
    assert L.report(docs.limit(0)).count() == 0


def test_large_groups_of_unlike_copies_meet_few_earlier_lines(spark, monkeypatch):
    """Copies of one line that are just about similar: most are settled by a bucket's leaders, few meet all earlier ones."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.145 else f"n{rng.randrange(10**6)}" for w in base)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, write = [], L.Scratch.write

    def counted(self, df):
        out = write(self, df)
        if out.columns == ["a", "b"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(L.Scratch, "write", counted)
    gone = {r.doc_id for r in L.report(docs).collect() if r.n_removed}
    assert gone == {i for i, (_, g, _) in want(rows).items() if g}
    # The last of the written pairs are all that the lists left to verify.
    assert 0 < met[-1] < 2600


def test_lists_are_of_rare_tokens_and_made_in_three_rounds(spark, monkeypatch):
    """Lines of 4 tokens that occur once and 8 that occur eight times are listed under the former; each list is in one round."""
    rng = random.Random(13)
    pool = [f"p{i}" for i in range(15_000) for _ in range(8)]
    rng.shuffle(pool)
    rows = [(i, " ".join([f"s{i}_{k}" for k in range(4)] + pool[8 * i : 8 * i + 8])) for i in range(15_000)]
    docs = L.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    rounds, listings = [], L.listings

    def counted(classes, turn):
        rounds.append([r.p for r in listings(classes, turn).select("p").collect()])
        return listings(classes, turn)

    monkeypatch.setattr(L, "listings", counted)
    assert not L.repeated_lines(docs).count()
    assert len(rounds) == 3
    lists = Counter(p for names in rounds for p in names)
    assert lists.total() > 4 * 14_900
    assert sum(k for k in lists.values() if k > 1) < 0.15 * lists.total()
