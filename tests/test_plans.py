import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnsift.plans.greedy import keep_if_quiet
from turnsift.plans.relay import relay
from turnsift.plans.timeline import Timeline, trailing_count


def make(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, seq long, v long, f boolean").withColumn(
        "ts", F.timestamp_seconds("t")
    )


def generated(seed, count=240, span=300):
    rng = random.Random(seed)
    return [
        (rng.choice("aaaaaabc"), rng.randint(0, span), i, rng.choice([None, 1, 2, 3]), rng.random() < 0.1)
        for i in range(count)
    ]


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_matches_a_loop(spark, mode, seed):
    rows = generated(seed)
    log = Timeline(make(spark, rows), ["k"], ["ts", "seq"]).scan(
        prev={"p": F.col("v")}, upto={"u": F.col("v")}, first={"f1": F.col("seq")},
        total={"n": F.coalesce("v", F.lit(0))}, tail={"last": (F.col("seq"), 4)}, lag={"third": (F.col("seq"), 3)},
    )
    assert log.blocked == (mode == "blocked")
    log = log.scan(prev={"after": F.col("v")}, back=True)
    log = trailing_count(log, "near", "ts", 5, ["seq"])
    got = {r.seq: r for r in log.result().collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            values = [r[3] for r in group]
            seen = [v for v in values[:i] if v is not None]
            ahead = [v for v in values[i + 1:] if v is not None]
            r = got[row[2]]
            assert r.p == (seen[-1] if seen else None)
            assert r.u == (row[3] if row[3] is not None else r.p)
            assert r.f1 == group[0][2]
            assert r.n == sum(v or 0 for v in values[: i + 1])
            assert list(r["last"]) == [g[2] for g in group[max(0, i - 4):i]]
            assert r.third == (group[i - 3][2] if i >= 3 else None)
            assert r.after == (ahead[0] if ahead else None)
            assert r.near == sum(1 for g in group[: i + 1] if row[1] - g[1] < 5)


def greedy(rows, window, strict, use_force):
    kept = {}
    for group in by_key(rows).values():
        last = None
        for _, t, seq, _, forced in group:
            far = last is None or (t - last >= window if strict else t - last > window)
            kept[seq] = far or (use_force and forced)
            last = t if kept[seq] else last
    return kept


@pytest.mark.parametrize("window,strict,use_force", [(5, False, False), (5, True, False), (30, False, True), (3, True, True)])
def test_keep_if_quiet_matches_a_loop(spark, mode, window, strict, use_force):
    rows = generated(window)
    forced = F.col("f") if use_force else None
    df = keep_if_quiet(make(spark, rows), ["k"], "ts", ["seq"], F.lit(window), strict, forced)
    assert {r.seq: r.kept for r in df.collect()} == greedy(rows, window, strict, use_force)


def test_keep_if_quiet_is_not_a_lag(spark, mode):
    rows = [("a", t, i, None, False) for i, t in enumerate([0, 4, 7, 9, 13])]
    df = keep_if_quiet(make(spark, rows), ["k"], "ts", ["seq"], F.lit(5))
    assert sorted(r.t for r in df.where("kept").collect()) == [0, 7, 13]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40))
def test_one_hot_key_over_many_blocks(spark, times):
    spark.conf.set("spark.turnsift.blocks", "6")
    rows = [("hot", t, i, None, False) for i, t in enumerate(times)]
    df = keep_if_quiet(make(spark, rows), ["k"], "ts", ["seq"], F.lit(7))
    spark.conf.unset("spark.turnsift.blocks")
    assert {r.seq: r.kept for r in df.collect()} == greedy(rows, 7, False, False)


def test_relay_matches_one_pass(spark, mode):
    rows = generated(9, count=300, span=100)

    def step(state, row):
        ring = state.setdefault("ring", [])
        new = row["t"] % 9 not in ring
        if new:
            ring.append(row["t"] % 9)
            del ring[:-4]
        return {"new": new}

    got = {r.seq: r.new for r in relay(make(spark, rows), ["k"], ["ts", "seq"], step, {"new": "boolean"}).collect()}
    want = {}
    for group in by_key(rows).values():
        state = {}
        for row in group:
            want[row[2]] = step(state, {"t": row[1]})["new"]
    assert got == want


def test_result_does_not_depend_on_input_order(spark, mode):
    rows = generated(4)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    results = [
        sorted((r.seq, r.kept) for r in keep_if_quiet(make(spark, r), ["k"], "ts", ["seq"], F.lit(5)).collect())
        for r in (rows, shuffled)
    ]
    assert results[0] == results[1]


def test_blocks_follow_the_input(spark, tmp_path):
    from turnsift.plans.timeline import BLOCK_BYTES, block_count

    spark.range(20_000).selectExpr("id", "uuid() as u").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert block_count(rows) == 1
    spark.conf.set(BLOCK_BYTES, "100000")
    try:
        one = block_count(rows)
        assert one > 3
        # What stands between the files and the scan does not matter, a second scan does.
        assert block_count(rows.groupBy("id").count()) == one
        assert block_count(rows.join(rows.withColumnRenamed("u", "v"), "id")) in (2 * one, 2 * one - 1)
    finally:
        spark.conf.unset(BLOCK_BYTES)


def remembering():
    """A step that never forgets: how many different values of ``t`` came before, and whether this one did."""

    def step(state, row):
        seen = state.setdefault("seen", [])
        new = row["t"] not in seen
        if new:
            seen.append(row["t"])
        return {"new": new, "n": len(seen)}

    return step


@pytest.mark.parametrize("blocks", [2, 8, 13])
def test_relay_rounds_grow_with_the_logarithm(spark, monkeypatch, blocks):
    """A state that outlives every block takes a round per doubling, not one per block."""
    from turnsift.plans import relay as module

    rounds = []
    composed = module._composed
    monkeypatch.setattr(module, "_composed", lambda *a: rounds.append(a[-1]) or composed(*a))
    rows = [("hot", i * 7 % 50, i, None, False) for i in range(120)] + [("cold", 1, 900, None, False)]
    spark.conf.set("spark.turnsift.blocks", str(blocks))
    try:
        df = relay(make(spark, rows), ["k"], ["seq"], remembering(), {"new": "boolean", "n": "bigint"})
    finally:
        spark.conf.unset("spark.turnsift.blocks")
    got = {r.seq: (r.new, r.n) for r in df.collect()}
    want = {}
    for group in by_key(rows).values():
        state = {}
        for row in sorted(group, key=lambda r: r[2]):
            out = remembering()(state, {"t": row[1]})
            want[row[2]] = (out["new"], out["n"])
    assert got == want
    assert len(rounds) <= (blocks - 1).bit_length() + 2


def test_relay_continues_given_states(spark, mode):
    rows = [("a", t, t, None, False) for t in range(40)] + [("b", t, 100 + t, None, False) for t in range(3)]
    start = spark.createDataFrame([("a", '{"seen": [0, 1, 2]}')], "k string, _state string")
    df = relay(make(spark, rows), ["k"], ["ts", "seq"], remembering(), {"new": "boolean", "n": "bigint"}, start, True)
    got = df.collect()
    assert {r.seq for r in got if not r.new} == {0, 1, 2}
    assert max(r.n for r in got if r.k == "b") == 3 and sum(r._state is not None for r in got) >= 2


def test_step_functions_compose(spark):
    import numpy as np
    import pandas as pd

    from turnsift.plans import greedy

    rng = random.Random(6)
    for _ in range(200):
        width, at = rng.randint(1, 30), 0
        parts = []
        for _ in range(3):
            times = sorted(at + rng.randint(0, 25) for _ in range(rng.randint(1, 9)))
            at = times[-1]
            part = pd.DataFrame({"k": "a", "_block": 0, "_t": times, "_width": width, "_forced": [rng.random() < 0.1 for _ in times]})
            head = greedy._step_function(part, ["k"]).iloc[0]
            parts.append((part.sort_values(["_t", "_forced"], kind="stable"), (np.array(head["bounds"]), np.array(head["exits"]))))
        both = greedy.composed(width, greedy.composed(width, parts[0][1], parts[1][1]), parts[2][1])
        other = greedy.composed(width, parts[0][1], greedy.composed(width, parts[1][1], parts[2][1]))
        # A row kept before is never later than the first row.
        for last in [greedy.NOTHING_KEPT, *range(-40, int(parts[0][0]["_t"].iloc[0]) + 1)]:
            state = last
            for part, _ in parts:
                for t, forced in zip(part["_t"], part["_forced"]):
                    state = t if forced or t - state > width else state
            for function in (both, other):
                assert int(greedy._applied(np.array([last]), width, *function)[0]) == state


def test_a_long_window_on_one_key_in_many_blocks(spark):
    """A day's window over a key of 32 blocks: no block decides anything, only the first row of each day is kept."""
    rows = [("hot", i * 3600, i, None, False) for i in range(200)]
    spark.conf.set("spark.turnsift.blocks", "32")
    try:
        df = keep_if_quiet(make(spark, rows), ["k"], "ts", ["seq"], F.lit(86_400))
    finally:
        spark.conf.unset("spark.turnsift.blocks")
    assert {r.seq: r.kept for r in df.collect()} == greedy(rows, 86_400, False, False)


def test_islands_are_folded_without_python(spark):
    rows = [("a", i // 700, i, None, False) for i in range(2500)]
    df = keep_if_quiet(make(spark, rows), ["k"], "ts", ["seq"], F.lit(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    assert {r.seq: r.kept for r in df.collect()} == greedy(rows, 1, False, False)
