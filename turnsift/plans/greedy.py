"""Keep-if-quiet: drop a row when a *kept* row of the same key lies within a window.

The decision depends on earlier decisions, so it is no ``lag``: with a 5 s window the times 0, 4, 7, 9, 13 keep
0, 7, 13.  A row without another row of its key in the window before it is kept whatever came before; such rows cut a
key into islands that are decided on their own.  An island is one ordered array, folded with the time of the last kept row as
its state, all in SQL functions.

A log of several blocks is cut into range-partitioned blocks.  A block that continues a key needs one number from before,
the time of the last kept row.  What a block makes of that number is a step function.  The functions of a key's blocks
are composed pairwise by doubling: after k joins each block knows the composition of itself and the 2^k - 1 blocks before
it, so a key of n blocks takes log2(n) rounds and no task sees more than two functions at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnsift.plans.timeline import BLOCK, block_count, cut_into_blocks, same, spanning_keys
from turnsift.session import cut_lineage

NOTHING_KEPT = -(2**62)
NEVER = 2**62
#: Rows folded at a time: flags of a piece are text, which each step copies.
PIECE = 512


def _next_kept(times: np.ndarray, width: int, forced: np.ndarray) -> np.ndarray:
    """For every row, the position of the row kept after it if it is kept itself."""
    count = len(times)
    later = np.searchsorted(times, times + width, side="right")
    positions = np.where(forced, np.arange(count), count)
    upcoming = np.minimum.accumulate(positions[::-1])[::-1]
    after = np.append(upcoming[1:], count)
    return np.minimum(later, after)


def _step_function(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Bounds and exits: the last kept time a block leaves for each last kept time it gets."""
    pdf = pdf.sort_values(["_t", "_forced"], kind="stable")
    times, forced, width = pdf["_t"].to_numpy(), pdf["_forced"].to_numpy(bool), int(pdf["_width"].iloc[0])
    count = len(times)
    following = _next_kept(times, width, forced).tolist()
    leave = times.tolist()
    for i in range(count - 1, -1, -1):
        if following[i] < count:
            leave[i] = leave[following[i]]
    limit = int(np.searchsorted(times, times[0] + width, side="right"))
    if forced.any():
        limit = min(limit, int(np.argmax(forced)))
    entries = range(min(limit + 1, count))
    bounds, exits = [], []
    for i in entries:
        bound = int(times[i]) if not forced[i] else NEVER
        if exits and exits[-1] == leave[i]:
            bounds[-1] = bound
        else:
            bounds.append(bound)
            exits.append(int(leave[i]))
    head = pdf.iloc[:1][[*keys, BLOCK, "_width"]].copy()
    head["bounds"], head["exits"] = [bounds], [exits]
    return head


def _applied(last: np.ndarray, width: int, bounds: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """What a block leaves for each last kept time: the exit of the first row that is far enough, or the time itself."""
    entry = np.searchsorted(bounds, last + width, side="right")
    return np.where(entry < len(exits), np.append(exits, 0)[entry], last)


def composed(width: int, first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two blocks in a row."""
    (bounds, exits), (more, after) = first, then
    # Up to the last bound of the first block its exits enter the second; beyond it the first keeps nothing.
    through = _applied(exits, width, more, after)
    rest = more > (bounds[-1] if len(bounds) else -NEVER)
    bounds, exits = np.append(bounds, more[rest]), np.append(through, after[rest])
    last = np.append(exits[1:] != exits[:-1], True)
    return bounds[last], exits[last]


def _composed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths, *lists = (batch.column(c).to_pylist() for c in ("_width", "bounds", "exits", "bounds0", "exits0"))
        bounds, exits = [], []
        for width, b, e, b0, e0 in zip(widths, *lists):
            if b0 is not None:
                as_arrays = [np.asarray(x, np.int64) for x in (b0, e0, b, e)]
                b, e = composed(width, tuple(as_arrays[:2]), tuple(as_arrays[2:]))
            bounds.append(b)
            exits.append(e)
        kept = [c for c in batch.schema.names if c not in ("bounds", "exits", "bounds0", "exits0")]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(bounds, kind), pa.array(exits, kind)], [*kept, "bounds", "exits"]
        )


def _kept_before(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Last kept time before each block of the keys that lie in several."""
    key_ddl = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    narrow = blocks.select(*keys, BLOCK, "_t", "_width", "_forced")
    steps = (
        narrow.alias("r").join(spans.alias("h"), same("r", "h", keys), "left_semi")
        .groupBy(*keys, BLOCK)
        .applyInPandas(
            lambda pdf: _step_function(pdf, keys),
            f"{key_ddl}, {BLOCK} int, _width bigint, bounds array<bigint>, exits array<bigint>",
        )
    )
    steps = cut_lineage(steps)
    # Blocks of a key are numbered on rows without their functions.
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_at")
    numbered = steps.select(*keys, BLOCK, at)
    steps = steps.alias("r").join(numbered.alias("n"), same("r", "n", [*keys, BLOCK])).select("r.*", "n._at")
    most = numbered.agg(F.max("_at")).first()[0] or 0
    ddl = f"{key_ddl}, {BLOCK} int, _width bigint, _at int, bounds array<bigint>, exits array<bigint>"
    steps, reach = cut_lineage(steps), 1
    while reach < most:
        earlier = steps.select(*keys, (F.col("_at") + reach).alias("_at"), F.col("bounds").alias("bounds0"), F.col("exits").alias("exits0"))
        both = steps.alias("r").join(earlier.alias("e"), same("r", "e", [*keys, "_at"]), "left")
        both = both.select(*[f"r.{c}" for c in (*keys, BLOCK, "_width", "_at", "bounds", "exits")], "e.bounds0", "e.exits0")
        steps = cut_lineage(both.mapInArrow(_composed_batches, ddl))
        reach *= 2
    # By now a block's function starts at the head of its key, where nothing was kept: its first exit is the time it leaves.
    left = steps.select(*keys, (F.col("_at") + 1).alias("_at"), F.get("exits", 0).alias("_before"))
    placed = steps.select(*keys, BLOCK, "_at").alias("r").join(left.alias("e"), same("r", "e", [*keys, "_at"]))
    return placed.select(*[f"r.{c}" for c in (*keys, BLOCK)], "e._before")


def _fold(rows: Column, before: Column) -> Column:
    """Flags of the ordered rows of one island, as pieces of text with a 1 for every kept row."""
    def step(state: Column, row: Column) -> Column:
        keep = row["_forced"] | (row["_t"] - state["last"] > row["_width"])
        return F.struct(
            F.when(keep, row["_t"]).otherwise(state["last"]).alias("last"),
            F.concat(state["flags"], F.when(keep, "1").otherwise("0")).alias("flags"),
        )

    def piece(state: Column, at: Column) -> Column:
        start = F.struct(state["last"].alias("last"), F.lit("").alias("flags"))
        done = F.aggregate(F.slice(rows, at * PIECE + 1, PIECE), start, step)
        return F.struct(done["last"].alias("last"), F.concat(state["flags"], F.array(done["flags"])).alias("flags"))

    start = F.struct(before.alias("last"), F.array().cast("array<string>").alias("flags"))
    pieces = F.sequence(F.lit(0), F.expr(f"(size(_rows) - 1) div {PIECE}").cast("int"))
    return F.aggregate(pieces, start, piece)["flags"]


def _decided(rows: DataFrame, groups: list[str], ties: list[str], columns: list[str]) -> DataFrame:
    """Cut each group into islands and fold them: ``columns`` and ``kept``."""
    order = ["_t", *[c for c in ties if c not in groups]]
    along = Window.partitionBy(*groups).orderBy(*order)
    gap = F.col("_t") - F.lag("_t").over(along)
    fresh = F.col("_forced") | F.coalesce(gap > F.col("_width"), F.lit(True))
    through = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_fresh", fresh.cast("int")).withColumn("_island", F.sum("_fresh").over(through))
    fields = list(dict.fromkeys([*order, "_forced", "_width", *[c for c in columns if c not in groups]]))
    islands = numbered.groupBy(*groups, "_island").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"), F.max("_before").alias("_before")
    )
    flagged = islands.withColumn("_flags", F.when(F.size("_rows") > 1, _fold(F.col("_rows"), F.col("_before"))))
    apart = flagged.select(*groups, "_before", "_flags", F.posexplode("_rows").alias("_at", "_row"))
    alone = F.col("_row._forced") | (F.col("_row._t") - F.col("_before") > F.col("_row._width"))
    flag = F.substr(F.get("_flags", F.expr(f"_at div {PIECE}").cast("int")), F.col("_at") % PIECE + 1, F.lit(1))
    kept = F.when(F.col("_flags").isNull(), alone).otherwise(flag == "1").alias("kept")
    return apart.select(*[F.col(c) if c in groups else F.col(f"_row.{c}").alias(c) for c in columns], kept)


def keep_if_quiet(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    window: Column,
    strict: bool = False,
    forced: Column | None = None,
) -> DataFrame:
    """Add ``kept``: false when a kept row of the key is at most ``window`` seconds older.

    With ``strict`` a kept row exactly ``window`` seconds older does not count.  Rows
    where ``forced`` is true are kept whatever came before.  ``window`` must be constant
    within a key.  Pass narrow rows: an island of them is one array.
    """
    keys, ties = list(keys), list(ties)
    width = F.round(window * F.lit(1_000_000).cast("bigint")).cast("bigint") - (1 if strict else 0)
    timed = df.withColumns({
        "_t": F.unix_micros(ts),
        "_width": width,
        "_forced": F.lit(False) if forced is None else F.coalesce(forced, F.lit(False)),
    })
    count = block_count(timed, share=4)
    nothing = F.lit(NOTHING_KEPT).cast("bigint")
    if count == 1:
        return _decided(timed.withColumn("_before", nothing), keys, ties, df.columns)
    blocks = cut_into_blocks(timed, keys, [F.col("_t"), *map(F.col, ties)], count)
    spans = spanning_keys(blocks, keys)
    before = _kept_before(blocks, spans, keys).alias("b")
    rows = blocks.alias("r").join(before, same("r", "b", [*keys, BLOCK]), "left")
    rows = rows.select("r.*", F.coalesce("b._before", nothing).alias("_before"))
    return _decided(rows, [*keys, BLOCK], ties, df.columns)
