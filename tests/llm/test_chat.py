import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnsift.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, part int"
HARD = ["", "<|end|>\n", "<\\|text|>", "<\\\\|", "<<||", "<|turn|>assistant<|text|>x<|end|>\n", "é<|日", "</s>[INST] ok [/INST]", "\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(HARD), st.text(alphabet="<|\\>a\né", max_size=12)), max_size=6))
def test_escapes_are_reversible(turns):
    roles, texts = (pa.array([t[k] for t in turns], pa.large_string()) for k in (0, 1))
    data, turn_at, _ = chat.assemble(chat.escape(roles), chat.escape(texts))
    assert chat.read_turns(data.tobytes()) == [(a.encode(), b.encode()) for a, b in turns]
    assert turn_at[-1] == len(data)


def digests(rows):
    groups = {}
    for c, turn, role, text, *_ in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = set()
    for c, turns in groups.items():
        turns = [(t[3], t[5]) for t in sorted(turns, key=lambda t: (*t[:3], t[3].encode(), t[4], t[5].encode()))]
        loss = "".join(x for r, x in turns if r == "assistant")
        long = sum(24 + sum(len(chat.escape(pa.array([v], pa.large_string()))[0].as_py()) for v in t) for t in turns)
        out.add((
            c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), long,
        ))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 50])
def test_read_back(spark, part_bytes):
    rows = [(1, k, "assistant" if k % 2 else "user", t, 5) for k, t in enumerate(HARD * 3)]
    rows += [(2, 0, None, None, 1), (2, None, "user", "first", 1), (2, 0, "assistant", "long " * 40_000, 1), (3, 1, "user", "a", 1)]
    rows += [(3, 1, "user", "a", 1), (3, 1, "user", "A", 1), (None, 0, "assistant", "lost", 1), (None, 1, "user", None, 1)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    parts = chat.format_conversations(df, part_bytes=part_bytes)
    assert {tuple(r) for r in chat.conversation_digests(parts).collect()} == digests(rows)
    if part_bytes == 50:
        assert parts.where("conv_id = 1").count() > 5


def test_a_conversation_runs_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, k, "assistant", f"text {k}", 0) for c in (1, 2) for k in range(20)]
        parts = chat.format_conversations(spark.createDataFrame(rows, TURNS))
        assert {tuple(r) for r in chat.conversation_digests(parts).collect()} == digests(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    parts = chat.format_conversations(spark.createDataFrame([], TURNS))
    assert chat.conversation_digests(parts).count() == 0
