from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chatterlake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
PIECES = st.lists(st.sampled_from(["\\", "\\\\", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<", "s>", "[", "$1", "\n", "é", "😀", " ok ", "/"]), max_size=6).map("".join)


def want(rows):
    out = {}
    for conv, turn, role, text, _ in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    result = {}
    for conv, turns in out.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        result[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return result


def test_hostile_texts_come_back(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from([None, 1, 2, -7]), st.sampled_from([None, 0, 1, 2, 3]), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system"]), PIECES), st.one_of(st.none(), PIECES), st.just(1)), max_size=60))
    def check(rows):
        got = {r.conv_id: tuple(r)[1:5] for r in C.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want(rows)

    check()


def test_examples_have_all_preceding_turns_and_one_reply(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </s>"), (1, 3, "user", "more"), (1, 4, "assistant", "é" * 50_000), (1, 5, "user", "bye"), (2, 0, "user", "alone")]
    found = C.formatted(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    examples = sorted(C.expanded(found).collect(), key=lambda r: r.example)
    assert [(r.conv_id, r.turn) for r in examples] == [(1, 2), (1, 4)]
    assert examples[0].context == "<s>[INST]system[/INST]be [\\INST] kind</s><s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]"
    assert examples[0].target == "hello <\\/s>" and examples[1].target == "é" * 50_000
    assert examples[1].context.startswith(examples[0].context + examples[0].target + "</s>")


def test_empty(spark):
    assert C.digests(spark.createDataFrame([], SCHEMA)).count() == 0
