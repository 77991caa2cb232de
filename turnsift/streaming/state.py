"""Step functions over streams: the state of a key lives in the stream's state store, in event time.

A batch job relays a state along a finished log (``turnsift.plans.relay``); here the same step functions run on rows as they
arrive.  Rows of a key wait in its state until the watermark has passed them, so they are decided in event order whatever
order they arrive in, and a stream gives what one pass over the log would give.  A row older than the watermark when it arrives
is late: it is dropped and decides nothing.  Timers in event time wake a key when a waiting row is ready, and forget it once it has been
idle for its lifetime.  State survives a restart; a repeated batch starts from the state before it.

Waiting rows and states are per key and bounded by what arrives within the delay and by the step function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnsift.operators.dedup import ID, genuine_exchange_step
from turnsift.functions import text as tx
from turnsift.operators.replay import FIELDS, prepare, replay_step

Step = Callable[[dict, dict], dict]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state needs; streams started from now on use it."""
    spark.conf.set(PROVIDER, ROCKS)


class Ordered(StatefulProcessor):
    """Runs ``step`` over the rows of a key in the order of (``at``, ``seq``), behind the watermark.

    ``at`` is the event time in microseconds.  ``idle`` is the lifetime of a state in microseconds since the last row of the key;
    None keeps it for ever.
    """

    def __init__(self, step: Step, columns: list[str], kinds: str, fields: list[str], idle: int | None):
        self.step, self.columns, self.kinds, self.fields, self.idle = step, columns, kinds, fields, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.memory = handle.getValueState("memory", "state string, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(row[c] for c in self.columns) for row in rows]
        if new:
            at = self.columns.index("at")
            self.waiting.appendList(new)
            self._wake(min(row[at] for row in new))
        return iter(())

    def _wake(self, at: int) -> None:
        # A row of the millisecond t is behind the watermark once that is past t.
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.columns, row)) for row in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r["at"] < mark), key=lambda r: (r["at"], r["seq"]))
        rest = [r for r in rows if r["at"] >= mark]
        state, last = self.memory.get() if self.memory.exists() else ("{}", None)
        memory = json.loads(state)
        out = []
        for row in ready:
            if self.idle is not None and last is not None and row["at"] - last > self.idle:
                memory = {}
            out.append(Row(**row, **self.step(memory, row)))
            last = row["at"]
        if ready:
            self.memory.update((json.dumps(memory, sort_keys=True), last))
            if rest:
                self.waiting.put([tuple(r[c] for c in self.columns) for r in rest])
            else:
                self.waiting.clear()
        if rest:
            self._wake(min(r["at"] for r in rest))
        elif last is not None and self.idle is not None:
            if last + self.idle < mark:
                self.memory.clear()
            else:
                self._wake(last + self.idle)
        return iter(out)

    def close(self) -> None:
        pass


def ordered_steps(rows: DataFrame, keys: list[str], step: Step, fields: dict[str, str], delay: str, idle: float | None = None) -> DataFrame:
    """The stream ``rows`` with the columns ``fields`` that ``step`` gives, each row once the watermark has passed it.

    ``rows`` needs ``ts`` and ``seq``, which order a key.  ``delay`` is how late rows may arrive, ``idle`` after how many seconds
    without rows a key is forgotten.
    """
    timed = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema)
    processor = Ordered(step, timed.columns, kinds, list(fields), None if idle is None else int(idle * 1_000_000))
    out = kinds + "".join(f", `{n}` {t}" for n, t in fields.items())
    return timed.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime").drop("at")


class Remember:
    """``fresh`` for a row whose key was not fresh within the last ``seconds``: an entry expires that long after it was made."""

    def __init__(self, seconds: float):
        self.life = int(seconds * 1_000_000)

    def __call__(self, state: dict, row: dict) -> dict:
        fresh = "made" not in state or row["at"] - state["made"] > self.life
        if fresh:
            state["made"] = row["at"]
        return {"fresh": fresh}


def remembered_stream(messages: DataFrame, keys: list[str], seconds: float, delay: str) -> DataFrame:
    """Messages with ``fresh``: entries of ``keys`` live exactly ``seconds``; a sight after that makes a new one."""
    return ordered_steps(messages, keys, Remember(seconds), {"fresh": "boolean"}, delay, seconds)


def first_seen_stream(messages: DataFrame, keys: list[str], seconds: float, delay: str) -> DataFrame:
    """First sights of ``keys``, forgotten ``seconds`` after they were made.  Pass a digest for a text: the state holds the key."""
    return remembered_stream(messages, keys, seconds, delay).where("fresh").drop("fresh")


def exchange_stream(events: DataFrame, delay: str) -> DataFrame:
    """``genuine`` for send, user and assistant events, by the state machine of a conversation.

    Columns as in ``genuine_response_strict``.  An exchange is open for fifteen seconds, so that is the lifetime of a state.
    """
    rows = events.select(
        *ID, "ts", "event", tx.digest(F.col("content")).alias("digest"), F.unix_micros("marked_ts").alias("marked_at")
    )
    return ordered_steps(rows, ["convo_id"], genuine_exchange_step, {"genuine": "boolean"}, delay, 15)


def replay_stream(
    messages: DataFrame, delay: str, idle: float = 86_400, historical: Column | None = None, signal_noise: Column | None = None
) -> DataFrame:
    """Strict replay decisions: ``action``, ``reasons`` and the rows that a row ``removed``; conversations live ``idle`` seconds."""
    rows = prepare(messages, historical, signal_noise).drop("at")
    return ordered_steps(rows, ["convo_id"], replay_step, FIELDS, delay, idle).select(*ID, "ts", *FIELDS)
