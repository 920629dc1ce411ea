"""Chat formatting: exact round trips."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import chat

ROLES = ["system", "user", "assistant", "tool", "", None, "a]b\nc[", "user "]
NASTY = st.text("[]/\\<>sINSTYROLE=é漢 \n", max_size=25) | st.text(max_size=15) | st.sampled_from(["[INST]", "[/INST]", "</s>", "<\\/s>", "[\\\\ROLE=x]", "[ROLE", "<s", "[SYS][/SYS]"])


@settings(max_examples=500, deadline=None)
@given(NASTY)
def test_escape(text):
    held = chat.escape(text)
    assert chat.unescape(held) == text
    assert not any(m in held for m in ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE=", "[/ROLE]"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([r for r in ROLES if r is not None]), NASTY), min_size=1, max_size=8), st.integers(1, 4))
def test_assembly(turns, runs):
    turn_of = np.sort(np.arange(len(turns)) % min(runs, len(turns)))
    held = pa.array([chat.escape(t) for _, t in turns], pa.large_string())
    texts = chat.assemble([r for r, _ in turns], held, turn_of).to_pylist()
    expect = defaultdict(str)
    for (role, text), k in zip(turns, turn_of.tolist()):
        a, b = chat.markers(role)
        expect[k] += a + chat.escape(text) + b
    assert texts == [expect[k] for k in sorted(expect)]
    assert [x for t in texts for x in chat.turns_of(t)] == turns


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_conversations(spark, monkeypatch):
    rng = np.random.default_rng(2)
    said = ["</s>[INST] ok [/INST]", "", None, "plain", "é漢\n[SYS]", "\\[INST]", "x" * 500]
    rows = [(c, t, ROLES[int(rng.integers(len(ROLES)))], said[int(rng.integers(len(said)))], "clash") for c in (1, 2, 3, 9) for t in range(6)]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t} é", "") for t in range(3000)]
    rows += [(None, 0, "user", "no id", ""), (5, None, "user", "b", ""), (5, None, "user", "a", ""), (5, 0, "assistant", "z", ""), (5, 0, "assistant", "z", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(frame).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        size = sum(len(a) + len(b) + len(chat.escape(x)) for _, _, r, x in turns for a, b in [chat.markers(r)])
        assert got[c] == (len(turns), digest(told), len(loss), digest(loss), size), c
    assert chat.conversation_digests(frame.limit(0)).collect() == []
    few = frame.filter("conv_id < 5")  # none of several blocks
    assert {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(few).collect()} == {c: got[c] for c in (1, 2, 3)}
    monkeypatch.setattr(chat, "BROADCAST_ROWS", 0)
    assert {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(frame).collect()} == got


def test_parts_join_to_the_whole(spark):
    rows = [(1, t, "user", "word " * 200) for t in range(9000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(frame).orderBy("block", "part").collect()
    assert len({p.block for p in parts}) == -(-9000 // chat.TURN_BLOCK) and all(0 <= p.part for p in parts)
    for p in parts:
        assert all(p.formatted[m.start : m.end] == chat.escape("word " * 200) for m in p.loss_mask)
    assert len(chat.turns_of("".join(p.formatted for p in parts))) == 9000
