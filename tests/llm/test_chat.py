import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, strategies as st

from gridpulse.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "###", "</turn>\n", "\\", "\\h", "####</turn", "### user: hi</turn>\n", "", None, "a:b\\c", "</turn></turn>", "#", "<", "é 😀"]


@given(st.text(alphabet="#</turn>\\hec: \n", max_size=40), st.text(alphabet="#</turn>\\hec: \n", max_size=40))
def test_round_trip(role, text):
    line = f"{chat.OPEN}{chat.escape(role, role=True)}: {chat.escape(text)}{chat.CLOSE}"
    assert chat.read_turns(line * 2) == [(role, text)] * 2


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(0, 20))
def test_spans_tile_and_fit(tokens, fixed):
    budget = chat.Budget(tokens=80)
    at = 0
    for back, start, end in chat.spans(np.array(tokens, dtype=int), fixed, budget):
        assert start == at and back <= start < end and start - back <= budget.history_turns
        assert fixed + sum(tokens[back:end]) <= 80 or end == start + 1
        at = end
    assert at == len(tokens)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for c in range(30):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * r.randint(0, 8)
        for t, role in enumerate(roles):
            out.append((c, t, role, r.choice(NASTY) if r.random() < 0.4 else "word " * r.randint(0, 60), "x"))
    out += [(100, 0, "system", "only", "x"), (101, None, "user", "no turn", "x"), (101, 3, None, "no role", "x"), (101, 3, "assistant", "tie", "x"),
            (None, 0, "assistant", "no id", "x"), (102, 7, "assistant", "twice", "x"), (102, 7, "assistant", "twice", "x"), (103, 0, "assistant", "long " * 5000, "x")]
    out += [(500, t, ("system", "user", "assistant")[t and 1 + t % 2], f"text {t}", "x") for t in range(1700)]
    r.shuffle(out)
    return out


def expected(rows):
    out = {}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("tokens,block", [(1024, 512), (120, 512), (60, 16)])
def test_read_back_equals_input(spark, rows, tokens, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(6)
    budget = chat.Budget(tokens=tokens, block_turns=block)
    windows = chat.format_chats(df, budget).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == expected(rows)
    for r in windows.collect():
        turns = chat.read_turns(r.formatted)
        assert len(turns) == r.n_turns and r.over_budget == (r.tokens > tokens)
        if r.over_budget:
            assert r.n_turns - r.first_new == 1 + (r.first_new == 0 and turns[0][0] == "system" and len(turns) > 1)
        if r.conv_id in (500, 0, 3, 6):
            assert turns[0][0] == "system"
    windows.unpersist()


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(none)).count() == 0
