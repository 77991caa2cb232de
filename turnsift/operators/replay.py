"""The full keep / drop / replace decision of every message, in strict order.

This is the reference point for the faster rules in ``dedup``: one pass per conversation
over a ring of the last fifty clean rows, with deletions.  The noise test is a Spark
expression evaluated beforehand; only the order-dependent part is stepped through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import noise as rules
from turnsift.plans.relay import relay
from turnsift.session import cut_lineage

# Rows and seconds each rule looks back.
RING, FRAGMENT_ROWS, NAME_ROWS, ECHO_ROWS = 50, 20, 10, 5
SECOND = 1_000_000
FIELDS = {"action": "string", "reasons": "array<string>", "removed": "array<bigint>"}


def _repeat_reason(ring: list[dict], row: dict) -> tuple[str | None, bool]:
    """(reason to drop, whether the row's text was kept before on this platform)."""
    assistant = row["role"] == "assistant"
    quiet = 2 if assistant else 5
    same = [r for r in ring if r["role"] == row["role"] and r["content"] == row["content"]]
    here = [r for r in same if r["platform"] == row["platform"]]
    if any(row["at"] - r["at"] <= quiet * SECOND for r in here):
        return "duplicate_window", True
    if assistant and any(row["at"] - r["at"] <= 30 * SECOND for r in same):
        return "assistant_repeat", True
    if row["prefix_blocked"] and ring:
        return "prefix_block", False
    if here and here[0]["at"] != row["at"]:
        if row["historical"]:
            return "historical_repeat", True
        if row["at"] - here[0]["at"] < 10 * SECOND:
            return "fast_repeat", True
        return None, True
    return None, False


def _echoes_user(ring: list[dict], row: dict) -> bool:
    text = row["content"].strip()
    lowered = row["content"].lower()
    for r in ring[-ECHO_ROWS:]:
        if r["role"] != "user" or r["platform"] != row["platform"]:
            continue
        age = row["at"] - r["at"]
        if age <= 10 * SECOND and r["content"].strip() == text:
            return True
        if age <= 30 * SECOND and r["content"].lower() in lowered:
            return False
    return False


def replay_step(state: dict, row: dict) -> dict:
    """Decide one message against the ring of clean rows and update the ring."""
    ring = state.setdefault("ring", [])
    recent = ring[-RING:]
    removed: list[int] = []
    reason, known = _repeat_reason(recent, row)
    if reason in ("duplicate_window", "assistant_repeat", "prefix_block"):
        return {"action": "drop", "reasons": [reason], "removed": removed}
    if row["role"] == "user" and recent:
        last = recent[-1]
        clean = last["content"][1:] if last["content"].startswith("J") else None
        if last["role"] == "user" and last["platform"] == row["platform"] and clean == row["content"]:
            removed.append(last["seq"])
            ring.remove(last)
    if reason:
        return {"action": "drop", "reasons": [reason], "removed": removed}
    assistant = row["role"] == "assistant"
    echo = assistant and not known and _echoes_user(recent, row)
    if assistant:
        for r in ring[-FRAGMENT_ROWS:]:
            age = row["at"] - r["at"]
            size = len(r["content"])
            if (
                r["role"] == "assistant" and r["platform"] == row["platform"] and 0 < age <= 5 * SECOND
                and 3 <= size < len(row["content"]) and row["content"].startswith(r["content"])
            ):
                gone = [o for o in ring if o["at"] == r["at"] and o["content"] == r["content"]]
                removed.extend(o["seq"] for o in gone)
                ring[:] = [o for o in ring if o not in gone]
                break
    if assistant and row["platform"] == "claude":
        for r in ring[-NAME_ROWS:]:
            if (
                r["role"] == "user" and r["platform"] == "claude" and 0 <= row["at"] - r["at"] <= 30 * SECOND
                and len(r["content"]) >= 10 and row["content"][1:] == r["content"]
            ):
                return {"action": "drop", "reasons": ["name_prefix_echo"], "removed": removed}
    reasons = ["user_input_echo"] if echo else []
    if row["noise"]:
        reasons.append(row["noise_rule"] or "signal")
    if reasons:
        return {"action": "verbose_only", "reasons": reasons, "removed": removed}
    ring.append({c: row[c] for c in ("seq", "at", "role", "platform", "content")})
    del ring[:-100]
    return {"action": "keep", "reasons": [], "removed": removed}


def prepare(messages: DataFrame, historical: Column | None = None, signal_noise: Column | None = None) -> DataFrame:
    """The columns the step needs, with the row-level rules already evaluated."""
    from turnsift.operators.dedup import prefix_block

    rule = rules.noise_rule(F.col("content"), F.col("urls"))
    marked = F.lit(False) if signal_noise is None else signal_noise
    return messages.select(
        "convo_id", "seq", "ts", F.unix_micros("ts").alias("at"), "platform", "role", "content",
        F.when(rules.is_noise(rule), rule).alias("noise_rule"),
        (rules.is_noise(rule) | marked).alias("noise"),
        (F.lit(False) if historical is None else historical).alias("historical"),
        prefix_block(F.col("role"), F.col("content")).alias("prefix_blocked"),
    )


def apply_removals(decided: DataFrame) -> DataFrame:
    """Final action per row: kept rows that a later row replaced become ``superseded``."""
    gone = decided.select("convo_id", F.explode("removed").alias("seq")).distinct()
    marked = decided.drop("removed").join(gone.withColumn("gone", F.lit(True)), ["convo_id", "seq"], "left")
    replaced = (F.col("action") == "keep") & F.col("gone").isNotNull()
    return marked.withColumn("action", F.when(replaced, "superseded").otherwise(F.col("action"))).drop("gone")


def replay_dedup(messages: DataFrame, historical: Column | None = None, signal_noise: Column | None = None) -> DataFrame:
    """DECISION table: ``action`` (keep, drop, verbose_only, superseded) and ``reasons``."""
    rows = prepare(messages, historical, signal_noise)
    # The decisions are read twice, for the rows and for what they remove.
    decided = cut_lineage(relay(rows, ["convo_id"], ["ts", "seq"], replay_step, FIELDS))
    return apply_removals(decided).select("convo_id", "seq", "ts", "platform", "role", "content", "action", "reasons")
