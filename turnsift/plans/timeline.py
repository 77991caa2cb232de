"""Ordered scans over keyed logs that stay balanced when one key is hot.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task, however large the key is.  A log is
therefore cut into blocks first: range-partitioned by (key, order), so that a hot key becomes several consecutive
blocks of ordinary size.  How many blocks there are follows from the bytes of the input files, which Spark knows
without running anything.  Windows run per (key, block), and what a
row needs from earlier blocks (the last value seen, a running sum, the last n rows)
comes from one summary row per block boundary.  There are never more of those than blocks; whether they are
broadcast or joined by (key, block), as the rows already lie, is left to Spark, which knows their size.  An input of one
block needs no cut, and nothing is written or counted for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnsift.session import cut_lineage

BLOCK = "_block"
BLOCKS = "spark.turnsift.blocks"
BLOCK_BYTES = "spark.turnsift.blockBytes"
DEFAULT_BLOCK_BYTES = 32 << 20
UNKNOWN = 1 << 62


def block_count(df: DataFrame, share: int = 1) -> int:
    """Blocks of about ``spark.turnsift.blockBytes`` bytes of input files; ``spark.turnsift.blocks`` sets the number itself.

    Jobs that take a block into Python ask for blocks of a ``share`` of that size.  Counts what the scans below ``df`` read.  Sources of unknown size count as one block per shuffle partition.
    """
    conf = df.sparkSession.conf
    if fixed := conf.get(BLOCKS, None):
        return int(fixed)
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size >= UNKNOWN for size in sizes):
        return int(conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-sum(sizes) * share // int(conf.get(BLOCK_BYTES, str(DEFAULT_BLOCK_BYTES)))))


def cut_into_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """Range-partition by (keys, order) and record the partition of each row as ``_block``.

    The range bounds come from a sample, so the result is written to the shared folder
    once: every later read sees the same cut, also after a lost executor.  A single block is left as it is.
    """
    if count == 1:
        return df.withColumn(BLOCK, F.lit(0))
    by = [F.col(k) for k in keys] + list(order)
    return cut_lineage(df.repartitionByRange(count, *by).withColumn(BLOCK, F.spark_partition_id()))


def spanning_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with rows in several blocks: at most one per block boundary.  Kept as a table."""
    ends = df.groupBy(*keys).agg(F.min(BLOCK).alias("_lo"), F.max(BLOCK).alias("_hi"))
    return cut_lineage(ends.where(F.col("_lo") < F.col("_hi")).select(*keys))


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition between two aliases: equal keys, nulls included."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def last_n(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


class Timeline:
    """A log with a key and a total order inside the key.

    ``order`` is a list of column names; a leading ``-`` means descending.  Together
    with the keys it must identify a row.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys = list(keys)
        self.order_names = list(order)
        count = block_count(df)
        self.blocked = count > 1
        self.df = cut_into_blocks(df, self.keys, self._order(), count) if self.blocked else df
        self.spans = spanning_keys(self.df, self.keys) if self.blocked else None

    def _order(self, back: bool = False) -> list[Column]:
        down = [(n.lstrip("-"), n.startswith("-") != back) for n in self.order_names]
        return [F.col(n).desc() if desc else F.col(n).asc() for n, desc in down]

    def _with(self, df: DataFrame) -> Timeline:
        other = object.__new__(Timeline)
        other.__dict__ = {**self.__dict__, "df": df}
        return other

    def where(self, condition: Column) -> Timeline:
        return self._with(self.df.where(condition))

    def columns(self, **columns: Column) -> Timeline:
        return self._with(self.df.withColumns(columns))

    def result(self, *columns: str) -> DataFrame:
        out = self.df.drop(BLOCK) if self.blocked else self.df
        return out.select(*columns) if columns else out

    def scan(
        self,
        prev: dict[str, Column] | None = None,
        upto: dict[str, Column] | None = None,
        first: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None,
        tail: dict[str, tuple[Column, int]] | None = None,
        lag: dict[str, tuple[Column, int]] | None = None,
        back: bool = False,
    ) -> Timeline:
        """Add columns that look back along the key, or ahead with ``back=True``.

        prev   nearest earlier non-null value (this row excluded)
        upto   nearest non-null value, this row included
        first  value of the first row of the key
        total  running sum, this row included
        tail   array of the n preceding rows' values, oldest first; values must not be null
        lag    value n rows before, null if the key has fewer rows
        """
        prev, upto, first, total, tail = prev or {}, upto or {}, first or {}, total or {}, tail or {}
        lag = lag or {}
        if self.blocked and lag:
            rings = {f"_ring_{n}": (F.struct(e.alias("v")), k) for n, (e, k) in lag.items()}
            ringed = self.scan(prev, upto, first, total, tail | rings, back=back)
            values = {
                n: F.when(F.size(f"_ring_{n}") == k, F.get(f"_ring_{n}", 0)["v"]) for n, (_, k) in lag.items()
            }
            return self._with(ringed.df.withColumns(values).drop(*rings))
        groups = self.keys + ([BLOCK] if self.blocked else [])
        order = self._order(back)
        w = Window.partitionBy(*groups).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        through = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {n: F.last(e, ignorenulls=True).over(before) for n, e in prev.items()}
        columns |= {n: F.last(e, ignorenulls=True).over(through) for n, e in upto.items()}
        columns |= {n: F.first(e).over(through) for n, e in first.items()}
        columns |= {n: F.sum(e).over(through) for n, e in total.items()}
        columns |= {n: F.collect_list(e).over(w.rowsBetween(-k, -1)) for n, (e, k) in tail.items()}
        columns |= {n: F.lag(e, k).over(w) for n, (e, k) in lag.items()}
        if not self.blocked:
            return self._with(self.df.withColumns(columns))

        carry = self._carry(prev | upto, first, total, tail, back).alias("c")
        local = self.df.withColumns(columns).alias("r")
        match = same("r", "c", [*self.keys, BLOCK])

        def merged(name: str) -> Column:
            here, there = F.col(f"r.{name}"), F.col(f"c.{name}")
            if name in first:
                return F.when(F.col(f"c.{BLOCK}").isNull(), here).otherwise(there)
            if name in total:
                return here + F.coalesce(there, F.lit(0))
            if name in tail:
                return F.when(there.isNull(), here).otherwise(last_n(F.concat(there, here), tail[name][1]))
            return F.coalesce(here, there)

        kept = [F.col(f"r.{c}") for c in self.df.columns if c not in columns]
        added = [merged(n).alias(n) for n in columns]
        return self._with(local.join(carry, match, "left").select(*kept, *added))

    def _carry(self, lasts, firsts, totals, tails, back) -> DataFrame:
        """For each block that continues a key: what the earlier blocks leave behind."""
        hot = self.spans.alias("h")
        rows = self.df.alias("r").join(hot, same("r", "h", self.keys), "left_semi")
        position = "_position"
        inside = Window.partitionBy(*self.keys, BLOCK).orderBy(*self._order(back))
        rows = rows.withColumn(position, F.row_number().over(inside))
        for name, (expr, n) in tails.items():
            rows = rows.withColumn(f"_tail_{name}", F.collect_list(expr).over(inside.rowsBetween(1 - n, 0)))
        aggregates = [F.max_by(e, F.when(e.isNotNull(), F.col(position))).alias(n) for n, e in lasts.items()]
        aggregates += [F.min_by(F.struct(e.alias("v")), position).alias(n) for n, e in firsts.items()]
        aggregates += [F.sum(e).alias(n) for n, e in totals.items()]
        aggregates += [F.max_by(f"_tail_{n}", position).alias(n) for n in tails]
        blocks = rows.groupBy(*self.keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)

        along = Window.partitionBy(*self.keys).orderBy(F.col(BLOCK).desc() if back else F.col(BLOCK))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        columns = [F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts]
        columns += [F.first(n).over(before)["v"].alias(n) for n in firsts]
        columns += [F.sum(n).over(before).alias(n) for n in totals]
        columns += [
            last_n(F.flatten(F.collect_list(n).over(along.rowsBetween(-k, -1))), k).alias(n)
            for n, (_, k) in tails.items()
        ]
        seen = F.sum("_rows").over(before).alias("_seen")
        return blocks.select(*self.keys, BLOCK, *columns, seen).where(F.col("_seen").isNotNull()).drop("_seen")


def trailing_count(log: Timeline, name: str, ts: str, seconds: float, id_columns: Sequence[str]) -> Timeline:
    """Rows of the key in the last ``seconds`` before a row, the row itself included.

    Counted as this row's position minus the rows that are already too old, which takes
    one pass however many rows share a second.  ``id_columns`` identify a row.
    """
    width = int(seconds * 1_000_000)
    if not log.blocked:
        here = Window.partitionBy(*log.keys).orderBy(*log._order())
        older = (
            Window.partitionBy(*log.keys)
            .orderBy(F.unix_micros(ts))
            .rangeBetween(Window.unboundedPreceding, -width)
        )
        return log.columns(**{name: F.row_number().over(here) - F.count(F.lit(1)).over(older)})
    id_columns = list(dict.fromkeys([*log.keys, *id_columns]))
    rows = log.df.select(*id_columns, F.unix_micros(ts).alias("_at"), *[n.lstrip("-") for n in log.order_names])
    rows = rows.select(*id_columns, "_at", F.struct(*[n.lstrip("-") for n in log.order_names]).alias("_place"))
    both = rows.withColumn("_probe", F.lit(0)).unionByName(
        rows.withColumn("_at", F.col("_at") - width).withColumn("_probe", F.lit(1))
    )
    counted = Timeline(both, log.keys, ["_at", "_probe", "_place"]).scan(
        total={"_n": F.when(F.col("_probe") == 0, 1).otherwise(0)}
    )
    sizes = counted.result().groupBy(*id_columns).agg(
        (F.max(F.when(F.col("_probe") == 0, F.col("_n"))) - F.max(F.when(F.col("_probe") == 1, F.col("_n")))).alias(name)
    )
    return log._with(log.df.join(sizes, id_columns))
