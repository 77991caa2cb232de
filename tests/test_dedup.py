import random

import pytest
from pyspark.sql import functions as F

from turnsift.operators import dedup, replay

U = "testmessage1757819022, respond okay1757819022"
SCENARIOS = {
    "five-fold": (
        [(i / 10, "assistant", "duplicate_test_message") for i in range(5)] + [(3.5, "assistant", "different_test_message")],
        [0, 5],
    ),
    "final": (
        [(0, "user", "testmessage34, respond okay34"), (0.5, "assistant", "okay34"), (0.7, "assistant", "okay34"),
         (0.75, "assistant", "okay34"), (1.7, "user", "testmessage35, respond okay35"), (2.2, "assistant", "okay35")],
        [0, 1, 4, 5],
    ),
    "saved run": ([(0, "user", U), (4, "assistant", "okay1757819022"), (23, "user", U), (27, "assistant", "okay1757819022")], [0, 1, 2]),
    "user 5 s edge": ([(0, "user", "XXX"), (5, "user", "XXX")], [0]),
    "user 7 s": ([(0, "user", "XXX"), (7, "user", "XXX")], [0]),
    "user 10 s": ([(0, "user", "XXX"), (10, "user", "XXX")], [0, 1]),
    "user two windows": ([(0, "user", "XXX"), (12, "user", "XXX"), (15, "user", "XXX"), (18, "user", "XXX")], [0, 1, 3]),
    "assistant edge": ([(0, "assistant", "XXX"), (30, "assistant", "XXX"), (31, "assistant", "XXX")], [0, 2]),
    "cross platform assistant": ([(0, "assistant", "XXX"), (10, "assistant", "XXX", {"platform": "chatgpt"})], [0]),
    "cross platform user": ([(0, "user", "XXX"), (1, "user", "XXX", {"platform": "chatgpt"})], [0, 1]),
    "historical": ([(0, "user", "XXX"), (3000, "user", "XXX", {"historical": True})], [0]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_repeat_rules(log, mode, name):
    rows, kept = SCENARIOS[name]
    df = dedup.dedup_messages(log(rows), historical="historical")
    assert sorted(r.seq for r in df.where("kept").collect()) == kept


@pytest.mark.parametrize("name", SCENARIOS)
def test_replay_agrees_on_scenarios(log, name):
    rows, kept = SCENARIOS[name]
    df = replay.replay_dedup(log(rows), historical=F.col("historical"))
    assert sorted(r.seq for r in df.where("action = 'keep'").collect()) == kept


REPLACED = {
    "prefix block": ([(0, "user", "hello there"), (1, "user", "Jtestmessage110, respond okay")], {1: "drop"}),
    "supersede": ([(0, "user", "Jhello world"), (2, "user", "hello world")], {0: "superseded"}),
    "fragment": ([(0, "assistant", "The answer"), (3, "assistant", "The answer is 42")], {0: "superseded"}),
    "fragment same time": ([(0, "assistant", "The answer"), (0, "assistant", "The answer is 42")], {}),
    "fragment too late": ([(0, "assistant", "The answer"), (6, "assistant", "The answer is 42")], {}),
    "name prefix": ([(0, "user", "testmessage"), (2, "assistant", "Xtestmessage")], {1: "drop"}),
    "exact echo": ([(0, "user", "tell me more"), (4, "assistant", "tell me more")], {1: "verbose_only"}),
    "late echo": ([(0, "user", "tell me more"), (14, "assistant", "tell me more")], {}),
}


@pytest.mark.parametrize("name", REPLACED)
def test_replay_decisions(log, mode, name):
    rows, changed = REPLACED[name]
    got = {r.seq: r.action for r in replay.replay_dedup(log(rows)).collect()}
    assert got == {i: changed.get(i, "keep") for i in range(len(rows))}


def test_single_rules_agree_with_replay(log, mode):
    rows = log(REPLACED["fragment"][0])
    assert [r.seq for r in dedup.stream_prefix_collapse(rows).collect()] == [1]
    rows = log(REPLACED["supersede"][0])
    assert {r.seq: r.superseded for r in dedup.supersede_prefixed(rows).collect()} == {0: True, 1: False}
    rows = log(REPLACED["name prefix"][0])
    assert {r.seq: r.blocked for r in dedup.name_prefix_echo(rows).collect()} == {0: False, 1: True}
    rows = log(REPLACED["exact echo"][0])
    assert {r.seq: r.label for r in dedup.user_echo_label(rows).collect()} == {0: None, 1: "exact"}
    rows = log([(0, "user", "more"), (4, "assistant", "Tell me MORE")])
    assert {r.seq: r.label for r in dedup.user_echo_label(rows).collect()} == {0: None, 1: "conversational"}


def generated(seed, count=45):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(count):
        t += rng.choice([0.25, 1, 2, 4, 6, 9, 21])
        role = rng.choice(["user", "assistant"])
        rows.append((t, role, f"{role} text {rng.randint(0, 2)}"))
    return rows


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_fast_rules_equal_replay(log, mode, seed):
    rows = log(generated(seed))
    fast = {r.seq for r in dedup.dedup_messages(rows).where("kept").collect()}
    strict = {r.seq for r in replay.replay_dedup(rows).where("action = 'keep'").collect()}
    assert fast == strict


def test_dedup_of_kept_rows_changes_nothing(log):
    rows = log(generated(6))
    kept = dedup.dedup_messages(rows).where("kept").select("convo_id", "seq")
    again = dedup.dedup_messages(rows.join(kept, ["convo_id", "seq"]))
    assert again.where("not kept").count() == 0


def test_recent_history_ring(log, mode):
    texts = [f"reply {i}" for i in range(21)] + ["reply 1", "reply 0", "ChatGPT said: reply 5"]
    rows = log([(i, "assistant", x) for i, x in enumerate(texts)])
    dropped = {r.seq for r in dedup.recent_history_dedup(rows).where("not kept").collect()}
    assert dropped == {21, 23}


POLICY = [
    ([(0, "user", "PLAY: song1.mp3"), (30, "assistant", "PLAY: song1.mp3")], "legitimate_musical_repeat"),
    ([(0, "user", "hello you"), (20, "user", "hello you")], "conversational_flow"),
    ([(0, "assistant", "hello you"), (600, "assistant", "hello you")], "historical_retransmission"),
    ([(0, "assistant", "hello you"), (120, "assistant", "hello you")], "orphaned_assistant_response"),
    ([(0, "user", "hello you"), (120, "user", "hello you")], "medium_term_duplicate"),
    ([(0, "user", "hello you"), (600, "user", "hello you")], "default_allow"),
]


@pytest.mark.parametrize("rows,reason", POLICY)
def test_repeat_policy(log, mode, rows, reason):
    got = [r.reason for r in dedup.repeat_policy(log(rows)).orderBy("seq").collect()]
    assert got == ["first_occurrence", reason]


def test_user_sends(log, mode):
    rows = log([(0, "user", "one"), (3, "user", "one"), (4, "user", "two"), (5, "user", "three"), (16, "user", "three")])
    got = {r.seq: r.accepted for r in dedup.user_send_dedup(rows).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_genuine_exchange(spark, log, mode):
    rows = [(0, "send", "hi you"), (0.3, "user", "hi you"), (0.4, "assistant", "old"), (2, "assistant", "answer"),
            (3, "assistant", "late"), (30, "user", "again"), (31, "assistant", "reply")]
    events = log(rows).withColumnRenamed("role", "event").withColumn(
        "marked_ts", F.when(F.col("content") == "again", F.timestamp_micros(F.unix_micros("ts") - 5_000_000))
    )
    got = {r.seq for r in dedup.genuine_response_strict(events).where("genuine").collect()}
    assert got == {1, 3, 5, 6}


def test_leading_char_echo(log, mode):
    users = [(i, "user", f"question number {i}") for i in range(25)]
    probes = [(30, "assistant", "question number 24"), (31, "assistant", "Jquestion number 24"), (32, "assistant", "abquestion number 24"),
              (33, "assistant", "abcquestion number 24"), (34, "assistant", "question number 4"), (35, "assistant", "question number 5")]
    rows = log(users + probes).withColumn("model", F.lit("opus-4.1"))
    got = [r.echo for r in dedup.leading_char_echo(rows).orderBy("seq").collect()]
    assert got == [True, True, True, False, False, True]


def test_debounce(log, mode):
    rows = log([(0, "assistant", "a"), (0.5, "assistant", "ab"), (1.4, "assistant", "abc"), (5, "assistant", "okay7")])
    got = dedup.debounce_last(rows, ["convo_id"], 1000).orderBy("emit_ts").collect()
    assert [(r.content, r.updates, r.text_changed) for r in got] == [("abc", 3, True), ("okay7", 1, False)]


def test_input_cleared(log, mode):
    rows = log([(0, "user", "he"), (1, "user", "hello"), (2, "user", "h"), (3, "user", ""), (4, "user", "")])
    assert [r.content for r in dedup.input_cleared_sends(rows).collect()] == ["hello"]


def test_states_that_outlive_blocks(log, mode):
    """A text that is too late for good, and a ring that whole blocks leave alone."""
    times = [0, 10, 100] + [101 + i for i in range(30)]
    rows = log([(t, "assistant", "same reply") for t in times])
    got = {r.seq for r in dedup.is_new_direct(rows).where("is_new").collect()}
    assert got == {0, 1}
    rows = log([(i, "assistant", f"reply {i % 3}") for i in range(40)])
    assert {r.seq for r in dedup.recent_history_dedup(rows).where("kept").collect()} == {0, 1, 2}


def test_null_keys_are_one_key(log, mode):
    rows = [(0, "user", "same", {"platform": None}), (1, "user", "same", {"platform": None}), (2, "user", "same", {"platform": None}),
            (3, None, None, {"platform": None}), (3.5, None, None, {"platform": None}), (20, "user", "same", {"platform": None})]
    assert {r.seq for r in dedup.dedup_window_role(log(rows)).where("kept").collect()} == {0, 3, 5}


def test_seen_texts_come_before_the_echo_test(log, mode):
    """Assistant X, user X, assistant X: the repeat is let through by its age; an echo alone is not."""
    rows = log([(0, "assistant", "what a day"), (5, "user", "what a day"), (10, "assistant", "what a day"), (12, "user", "and now"),
                (13, "assistant", "and now"), (31, "assistant", "what a day")]).withColumn("model", F.lit("opus-4.1"))
    got = {r.seq: r.passes for r in dedup.first_sight_filter(rows).collect()}
    assert got == {0: True, 2: True, 4: False, 5: False}


def test_user_clock_shares_the_memory_of_texts(log, mode):
    rows = log([(0, "user", "hello you"), (50, "assistant", "hello you"), (100, "user", "hello you"), (180, "assistant", "new text")])
    assert {r.seq for r in dedup.is_new_direct(rows).where("is_new").collect()} == {0, 1, 2, 3}


def test_direct_memory_forgets_old_texts(log, mode):
    """Beyond a hundred texts those older than ten minutes go, so the first text is new again."""
    rows = [(0, "user", "first")] + [(1 + i, "user", f"text {i}") for i in range(99)]
    late = [(900, "user", "other"), (901, "user", "first"), (902, "user", "text 5")]
    assert [r.is_new for r in dedup.is_new_direct(log(rows + late)).orderBy("seq").collect()[-3:]] == [True, True, True]
    few = [(0, "user", "first"), (900, "user", "other"), (901, "user", "first")]
    assert [r.is_new for r in dedup.is_new_direct(log(few)).orderBy("seq").collect()] == [True, True, False]


def test_a_reply_ends_the_waiting(log, mode):
    rows = log([(0, "user", "one"), (0.3, "assistant", "old"), (1, "user", "two"), (1.2, "assistant", "reply"), (1.5, "user", "three"),
                (1.9, "user", "four"), (9, "user", "four"), (20, "user", " ")])
    got = {r.seq: r.accepted for r in dedup.user_send_dedup(rows).collect()}
    # "two" is refused, the reply to "one" ends the waiting, "three" counts at once and "four" comes too early.
    assert got == {0: True, 2: False, 4: True, 5: False, 6: False}
