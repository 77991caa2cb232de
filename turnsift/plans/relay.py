"""Sequential state machines over keyed logs, cut into blocks when a key is long.

Some rules carry a state that no window expresses (a ring of the last kept rows, an open exchange).  Every block is a
function from the state it gets to the state it leaves.  All blocks of a long key are run once from the empty state; then
functions are composed by doubling.  In round k stretches of 2^k blocks are composed: a stretch in which a block got another state
than it ran with is run again from there, in order, and from the block where its state agrees with the state found before
it is not run any further but takes over what was found.  After round k the first 2^(k+1) blocks of every key are right, so
a key of n blocks takes at most log2(n) + 1 rounds, however long its state remembers; rules that forget settle in the
first.  The result equals one sequential pass.  Stretches are streamed: a task holds one batch and one state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnsift.plans.timeline import BLOCK, block_count, cut_into_blocks, same, spanning_keys
from turnsift.session import cut_lineage

Step = Callable[[dict, dict], dict]
ARROW = {
    "boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()),
    "array<bigint>": pa.list_(pa.int64()),
}
STATE = "_state"
INCOMING, OUTGOING = "_incoming", "_outgoing"


def _dumped(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def _run(rows: list[dict], keys: list[str], states: dict[tuple, str], step: Step) -> tuple[list[dict], list[str | None]]:
    """Results per row, and per row the state of its key after it if it is the key's last row."""
    current, memory = None, {}
    results, after = [], []
    for row in rows:
        key = tuple(row[k] for k in keys)
        if key != current:
            if after:
                after[-1] = _dumped(memory)
            memory = json.loads(states.get(key) or "{}")
            current = key
        results.append(step(memory, row))
        after.append(None)
    if after:
        after[-1] = _dumped(memory)
    return results, after


def _states(table: pa.Table, keys: list[str]) -> dict[tuple, str]:
    return {tuple(r[k] for k in keys): r[INCOMING] for r in table.to_pylist()}


def _own_columns(df: DataFrame) -> DataFrame:
    """``df`` under new column identities, so that it can be cogrouped with its origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class _Stretch:
    """Runs the blocks of one stretch in order: each starts with a header row, which has no values of ``order``."""

    def __init__(self, keys: list[str], step: Step):
        self.keys, self.step = keys, step
        self.place, self.memory, self.given, self.left, self.asleep = None, None, None, None, False
        self.out: list[dict] = []

    def header(self, row: dict) -> None:
        self.finish()
        place = (*[row[k] for k in self.keys], row["_stretch"])
        if self.place is None or self.place[:-1] != place:
            given = row["_handed"]
        else:
            given = self.left
        self.place, self.given = (*place, row[BLOCK]), given
        # A block that already ran with this state leaves what it left then.
        self.asleep = bool(row["_ran"]) and given == row[INCOMING]
        self.left = row[OUTGOING] if self.asleep else None
        self.memory = None if self.asleep else json.loads(given or "{}")

    def row(self, row: dict) -> None:
        if not self.asleep:
            self.step(self.memory, row)

    def finish(self) -> None:
        if self.place is None or self.asleep:
            return
        self.left = _dumped(self.memory)
        *key, _, block = self.place
        self.out.append(dict(zip(self.keys, key)) | {BLOCK: block, INCOMING: self.given, OUTGOING: self.left})


def _composed(hot: DataFrame, states: DataFrame, keys: list[str], order: list[str], step: Step, reach: int) -> DataFrame:
    """Blocks whose state changed in stretches of ``reach`` blocks: keys, block, state in and out.

    ``states`` has a row per block: its number ``_at`` in the key, what it ran with (``_ran`` false: it never ran) and left.
    """
    before = states.select(*keys, (F.col("_at") + 1).alias("_at"), F.col(OUTGOING).alias("_left"))
    told = states.alias("r").join(before.alias("b"), same("r", "b", [*keys, "_at"]), "left").select(
        "r.*", F.when(F.col("r._at") == 0, F.col(f"r.{INCOMING}")).otherwise(F.col("b._left")).alias("_handed"),
    ).withColumn("_stretch", F.expr(f"_at div {reach}"))
    wrong = ~(F.col("_ran") & F.col("_handed").eqNullSafe(F.col(INCOMING)))
    firsts = told.where(wrong).groupBy(*keys, "_stretch").agg(F.min("_at").alias("_from"))
    todo = told.alias("r").join(firsts.alias("f"), same("r", "f", [*keys, "_stretch"])).where("r._at >= f._from").select("r.*")
    headers = cut_lineage(todo.select(*keys, "_stretch", BLOCK, "_ran", INCOMING, OUTGOING, "_handed"))
    places = headers.select(*keys, "_stretch", BLOCK).alias("h")
    rows = hot.alias("r").join(places, same("r", "h", [*keys, BLOCK])).select("r.*", "h._stretch")
    both = headers.withColumn("_header", F.lit(0)).unionByName(rows.withColumn("_header", F.lit(1)), allowMissingColumns=True)
    along = [*keys, "_stretch", BLOCK, "_header", *order]
    both = both.repartition(*keys, "_stretch").sortWithinPartitions(*along)
    schema = ", ".join(f"`{k}` {hot.schema[k].dataType.simpleString()}" for k in keys) + f", {BLOCK} int, {INCOMING} string, {OUTGOING} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, target = _Stretch(keys, step), None
        for batch in batches:
            if target is None:
                target = pa.schema([batch.schema.field(c) for c in (*keys, BLOCK)] + [pa.field(c, pa.string()) for c in (INCOMING, OUTGOING)])
            for row in batch.to_pylist():
                (stretch.row if row["_header"] else stretch.header)(row)
            if stretch.out:
                yield pa.RecordBatch.from_pylist(stretch.out, target)
                stretch.out = []
        stretch.finish()
        if stretch.out:
            yield pa.RecordBatch.from_pylist(stretch.out, target)

    return both.mapInArrow(run, schema)


def _settled(hot: DataFrame, starts: DataFrame, keys: list[str], order: list[str], step: Step) -> DataFrame:
    """The state each block of the long keys starts from; ``starts`` has it for the first block of a key."""
    places = hot.select(*keys, BLOCK).distinct()
    numbered = places.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)) - 1)
    first = numbered.alias("r").join(starts.alias("s"), same("r", "s", [*keys, BLOCK]), "left")
    none = F.lit(None).cast("string").alias(OUTGOING)
    states = cut_lineage(first.select("r.*", F.col(f"s.{INCOMING}").alias(INCOMING), none, F.lit(False).alias("_ran")))
    most = states.agg(F.max("_at")).first()[0] or 0
    reach = 1
    while True:
        # Blocks that have not run yet start from the empty state; the first round runs every block for itself.
        new = cut_lineage(_composed(hot, states, keys, order, step, reach))
        if reach > 1 and new.isEmpty():
            return states
        kept = states.alias("r").join(new.alias("n"), same("r", "n", [*keys, BLOCK]), "left")
        ran = F.col(f"n.{OUTGOING}").isNotNull()
        states = cut_lineage(kept.select(
            *[f"r.{c}" for c in (*keys, BLOCK, "_at")], *[F.when(ran, F.col(f"n.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in (INCOMING, OUTGOING)],
            (ran | F.col("r._ran")).alias("_ran"),
        ))
        if reach > most:
            return states
        reach *= 2


def relay(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    fields: dict[str, str],
    initial: DataFrame | None = None,
    keep_state: bool = False,
) -> DataFrame:
    """Add the columns ``fields`` (name to type) computed by ``step(state, row)`` in order.

    ``step`` changes ``state`` (a JSON-like dict, empty at the start of a key) in place
    and returns the values of ``fields`` for the row.  Keys must not be null.  ``initial``
    (keys and ``_state``) gives the state keys start from; with ``keep_state`` the result
    has ``_state`` on the last row a key has in a block.
    """
    keys, order = list(keys), list(order)
    count = block_count(df, share=8)
    blocks = cut_into_blocks(df, keys, [F.col(c) for c in order], count)
    where = [*keys, BLOCK]

    def decide(rows: pa.Table, incoming: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in [*keys, *order]])
        results, after = _run(rows.to_pylist(), keys, _states(incoming, keys), step)
        rows = rows.drop_columns([BLOCK])
        for name, kind in fields.items():
            rows = rows.append_column(name, pa.array([r[name] for r in results], ARROW[kind]))
        return rows.append_column(STATE, pa.array(after, pa.string())) if keep_state else rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema += "".join(f", `{n}` {t}" for n, t in fields.items()) + (f", {STATE} string" if keep_state else "")
    if count == 1 and initial is None:
        # Whole keys are dealt to tasks; none continues anywhere.
        nothing = pa.table({INCOMING: pa.array([], pa.string())})
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.withColumn(BLOCK, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).repartition(parts, BLOCK)
        return dealt.groupBy(BLOCK).applyInArrow(lambda rows: decide(rows, nothing), schema)
    starts = blocks.groupBy(*keys).agg(F.min(BLOCK).alias(BLOCK))
    if initial is None:
        starts = starts.withColumn(INCOMING, F.lit(None).cast("string"))
    else:
        starts = starts.join(initial.select(*keys, F.col(STATE).alias(INCOMING)), keys, "left")
    incoming = starts.select(*where, INCOMING)
    spans = spanning_keys(blocks, keys) if count > 1 else None
    if spans is not None and not spans.isEmpty():
        hot = blocks.join(spans, keys, "left_semi")
        states = _settled(hot, starts.join(spans, keys, "left_semi"), keys, order, step)
        incoming = incoming.join(spans, keys, "left_anti").unionByName(states.select(*where, INCOMING))
    incoming = incoming.where(F.col(INCOMING).isNotNull())
    return blocks.groupBy(BLOCK).cogroup(_own_columns(incoming).groupBy(BLOCK)).applyInArrow(decide, schema)
