"""Prefix trie of conversations, built as double arrays shard by shard and merged globally.

Every conversation is a sequence of turns; a node is a distinct sequence of first turns.  Sequences are cut into bands of 64 turns, so that
a conversation of any length is many short rows, each of which knows the prefix that it continues (two 64-bit sums of position-mixed
turn hashes) and the bytes before it.  The rows are dealt by range, in the order of their prefixes: a shard holds neighbouring prefixes, and a
prefix that half of all conversations share is simply spread over several shards.

A task takes its shard in chunks.  The turns of a chunk get dense ids; BASE and CHECK are packed level by level over them (the children
of a node stand at BASE[node] + id, where CHECK names the node); sequences are then walked through the arrays to find their nodes, and what
belongs to a node is summed.  Nodes that shards and chunks share, the upper ones above all, are merged by a combinable grouping.

Sums over subtrees need no second structure.  A node belongs to its smallest member, and what a conversation owns is a suffix of its path.
So a subtree's leaves are the members that own a childless end, its children the members that own their next turn, and its saved bytes the
sum over its members of the bytes between the node and the first turn they own.

A null ``conv_id`` belongs to no conversation and is left out; null roles and texts are empty; null turns stand first, equal ones in the order
of role and text; repeated rows are turns of their own.  An empty table has no nodes.  Texts have any length: only hashes and sizes
travel behind the ordering.  Other columns are ignored.  The hash of the members that end in a node reads them in order, a node
in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.plans.timeline import Timeline
from turnsift.session import cut_lineage

#: Fixed values of the contract: conversations share a start in groups of 5, of up to 8 turns.
GROUP, HEADS = 5, 9
BAND = 64
CHUNK = 20_000
KEY = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over sequences of dense ids; slot 0 is the root."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        most = int(ids.max(initial=0)) + 1
        self.base = np.zeros(len(ids) + most + 2, np.int64)
        self.check = np.full(len(ids) + most + 2, -1, np.int64)
        self.check[0] = 0
        slot = np.zeros(len(starts), np.int64)
        for level in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > level)
            here = ids[starts[on] + level]
            pairs = np.unique(np.stack([slot[on], here]), axis=1)
            self._add(pairs[0], pairs[1])
            slot[on] = self.base[slot[on]] + here

    def _add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Give every parent its children, which stand together in order."""
        new = np.append(True, parents[1:] != parents[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(parents)))
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = ids[at : at + size]
            base = self._fit(own)
            self.base[parents[at]] = base
            self.check[base + own] = parents[at]
        single = starts[sizes == 1]
        if len(single):
            free = np.flatnonzero(self.check < 0)
            if len(free) < len(single):
                self._grow(len(self.check) + len(single))
                free = np.flatnonzero(self.check < 0)
            free = free[: len(single)]
            self.base[parents[single]] = free - ids[single]
            self.check[free] = parents[single]

    def _fit(self, own: np.ndarray) -> int:
        """The first base that puts all children on free slots."""
        spread = own - own[0]
        free = np.flatnonzero(self.check < 0)
        for at in range(0, len(free), 256):
            some = free[at : at + 256]
            some = some[some + spread[-1] < len(self.check)]
            good = (self.check[some[:, None] + spread] < 0).all(axis=1)
            if good.any():
                return int(some[good.argmax()] - own[0])
        first = len(self.check)
        self._grow(first + int(spread[-1]) + 1)
        return first - int(own[0])

    def _grow(self, size: int) -> None:
        more = max(size, 2 * len(self.check)) - len(self.check)
        self.base = np.append(self.base, np.zeros(more, np.int64))
        self.check = np.append(self.check, np.full(more, -1, np.int64))

    def walk(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of every place of the sequences; -1 from where a sequence leaves the trie."""
        out = np.full(len(ids), -1, np.int64)
        slot = np.zeros(len(starts), np.int64)
        for level in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > level) & (slot >= 0))
            at = starts[on] + level
            to = self.base[slot[on]] + ids[at]
            inside = (to >= 0) & (to < len(self.check))
            inside[inside] = self.check[to[inside]] == slot[on][inside]
            slot[on] = np.where(inside, to, -1)
            out[at] = slot[on]
        return out


def dense_ids(m1: np.ndarray, m2: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Turns numbered by where they first appear, level by level, so that siblings have near ids."""
    order = np.lexsort((m2, m1))
    new = np.append(True, (np.diff(m1[order]) != 0) | (np.diff(m2[order]) != 0))
    name = np.empty(len(m1), np.int64)
    name[order] = np.cumsum(new) - 1
    by_level = np.argsort(level, kind="stable")
    _, first = np.unique(name[by_level], return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    return rank[name]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _nodes(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of a chunk of rows: what each place of the sequences knows, its row, and the number of its node."""
    lists = table["m1"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    m1, m2, size = (table[c].combine_chunks().flatten().to_numpy() for c in ("m1", "m2", "size"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    level = np.arange(len(m1)) - starts[row]
    # A shard may hold several prefixes; each starts with a turn of its own, so that all fit into one trie.
    p1, p2, band = (table[c].to_numpy() for c in ("p1", "p2", "band"))
    heads, head = np.unique(np.stack([band, p1, p2]), axis=1, return_inverse=True)
    ids = dense_ids(m1, m2, level)
    longer = np.insert(ids + heads.shape[1], starts, head.reshape(-1))
    trie = DoubleArray(longer, starts + np.arange(len(starts)), sizes + 1)
    slots = trie.walk(longer, starts + np.arange(len(starts)), sizes + 1)
    slots = np.delete(slots, starts + np.arange(len(starts)))

    def prefix(values: np.ndarray, before: np.ndarray) -> np.ndarray:
        through = np.cumsum(values)
        return through - (through - values)[starts][row] + before[row]

    place = {
        "depth": table["above"].to_numpy()[row] + level + 1, "k1": prefix(m1, p1), "k2": prefix(m2, p2),
        "before": prefix(size, table["start"].to_numpy()) - size, "size": size, "m1": m1, "m2": m2,
        "ends": (level == sizes[row] - 1) & table["last"].to_numpy(zero_copy_only=False)[row],
    }
    return place, row, np.unique(slots, return_inverse=True)[1]


def _numbers(values: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values.values()], list(values))


def _sums(node: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, np.int64)
    np.add.at(out, node, values)
    return out


def _members(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for table in _chunks(batches, chunk):
        place, row, node = _nodes(table)
        _, first = np.unique(node, return_index=True)
        conv = table["conv_id"].to_numpy()[row]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, node, conv)
        at = np.flatnonzero(place["ends"])
        at = at[np.argsort(node[at], kind="stable")]
        offsets = np.searchsorted(node[at], np.arange(len(first) + 1))
        out = {c: place[c][first] for c in KEY}
        out |= {"up1": (place["k1"] - place["m1"])[first], "up2": (place["k2"] - place["m2"])[first], "before": place["before"][first]}
        batch = _numbers(out | {"n_convs": np.bincount(node, minlength=len(first)), "conv_id": least})
        ends = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(conv[at]))
        yield pa.RecordBatch.from_arrays([*batch.columns, ends], [*batch.schema.names, "ends"])


def _subtrees(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for table in _chunks(batches, chunk):
        place, row, node = _nodes(table)
        _, first = np.unique(node, return_index=True)
        unowned, length, bytes_ = (table[c].to_numpy()[row] for c in ("unowned", "length", "unowned_bytes"))
        leaf = table["leaf"].to_numpy(zero_copy_only=False)[row]
        depth = place["depth"]
        yield _numbers({c: place[c][first] for c in KEY} | {
            "n_children": _sums(node, (length > depth) & (unowned <= depth), len(first)),
            "n_leaves": _sums(node, leaf, len(first)),
            "saved": _sums(node, np.maximum(0, bytes_ - place["before"]), len(first)),
        })


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
            if node != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(b"%d" % conv)
            else:
                digest.update(b",%d" % conv)
        yield _hashes(done)
    if key is not None:
        yield _hashes([(*key, digest.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])


def _wrapped(name: str) -> Column:
    """A decimal sum of 64-bit values as the 64-bit value that overflow would leave."""
    return F.expr(f"cast(pmod({name} + 9223372036854775808, 18446744073709551616) - 9223372036854775808 as bigint)")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), two hashes and the ``size`` in bytes of every turn."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = Timeline(rows, ["conv_id"], ["turn", "role", "text"]).scan(total={"place": F.lit(1).cast("bigint")}).result()
    return placed.select(
        "conv_id", "place", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations that start like the first of their group of five, and all conversations."""
    head = F.array_sort(F.collect_list(F.struct("place", "t1", "t2", "size")))
    heads = cut_lineage(turns.where(F.col("place") < HEADS).groupBy("conv_id").agg(head.alias("head")))
    borrowed = F.crc32(F.col("conv_id").cast("string")) % HEADS
    wanted = heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("of"), borrowed.cast("int").alias("h"))
    lent = heads.select(F.col("conv_id").alias("of"), "head")
    start = F.coalesce(F.slice("head", 1, F.col("h")), F.expr("array()").cast(heads.schema["head"].dataType))
    starts = cut_lineage(wanted.join(lent, "of", "left").select("conv_id", start.alias("start"), F.size(start).alias("k")))
    first = starts.select("conv_id", F.inline("start")).withColumnRenamed("place", "depth")
    own = turns.where(F.col("place") > borrowed).join(starts.select("conv_id", "k"), "conv_id")
    own = own.withColumn("depth", F.col("place") - borrowed + F.col("k")).drop("place", "k")
    return first.unionByName(own.select(*first.columns)), heads.select("conv_id")


def banded(turns: DataFrame, width: int = BAND) -> DataFrame:
    """Conversations in rows of ``width`` turns: ``conv_id, band, above`` (turns before), ``p1, p2, start, last, m1, m2, size, bytes``."""
    mixed = turns.select(
        "conv_id", F.expr(f"(depth - 1) div {width}").alias("band"),
        F.struct("depth", F.xxhash64("depth", "t1", "t2").alias("m1"), F.xxhash64("t2", "t1", "depth").alias("m2"), "size").alias("turn"),
    )
    rows = mixed.groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), *[
            F.sum(F.col(f"turn.{m}").cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"sum_{m}") for m in ("m1", "m2")
        ], F.sum("turn.size").alias("bytes"),
    )
    rows = cut_lineage(rows)
    # Only conversations of several bands have a prefix to look up.
    long = rows.where("band = 1").select("conv_id")
    narrow = rows.select("conv_id", "band", "sum_m1", "sum_m2", "bytes").join(long, "conv_id", "left_semi")
    sums = {"t1": F.col("sum_m1"), "t2": F.col("sum_m2"), "through": F.col("bytes")}
    summed = Timeline(cut_lineage(narrow), ["conv_id"], ["band"]).scan(total=sums)
    summed = summed.scan(prev={"next": F.col("band")}, back=True).result().select(
        "conv_id", "band", (F.col("t1") - F.col("sum_m1")).alias("p1"), (F.col("t2") - F.col("sum_m2")).alias("p2"),
        (F.col("through") - F.col("bytes")).alias("start"), F.col("next").isNull().alias("last"),
    )
    prefixes = summed.select("conv_id", "band", _wrapped("p1").alias("p1"), _wrapped("p2").alias("p2"), "start", "last")
    zero = F.lit(0).cast("bigint")
    return rows.join(prefixes, ["conv_id", "band"], "left").select(
        "conv_id", "band", (F.col("band") * width).alias("above"), *[F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "start")], F.coalesce("last", F.lit(True)).alias("last"),
        "turns.m1", "turns.m2", "turns.size", "bytes",
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in the order of their prefixes, dealt by range; a prefix of many conversations is spread over several shards."""
    order = ["band", "p1", "p2", *[F.get("m1", i) for i in range(4)], "conv_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def prefix_nodes(turns: DataFrame, conversations: DataFrame, width: int = BAND, chunk: int = CHUNK) -> DataFrame:
    """The nodes of sequences ``conv_id, depth, t1, t2, size``; ``conversations`` lists all, also those without turns."""
    rows = cut_lineage(banded(turns, width))
    found = cut_lineage(_dealt(rows.drop("bytes")).mapInArrow(
        lambda batches: _members(batches, chunk), "depth bigint, k1 bigint, k2 bigint, up1 bigint, up2 bigint, before bigint, n_convs bigint, conv_id bigint, ends array<bigint>"
    ))
    nodes = cut_lineage(found.groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in ("up1", "up2", "before", "conv_id")], F.sum("n_convs").alias("n_convs"),
        F.sum(F.size("ends")).alias("n_ends"),
    ))
    owned = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before")).alias("first"), F.max(F.struct("depth", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))).alias("end")
    )
    whole = rows.where("last").select("conv_id", (F.col("above") + F.size("m1")).alias("length"), (F.col("start") + F.col("bytes")).alias("all_bytes"))
    facts = cut_lineage(whole.join(owned, "conv_id", "left").select(
        "conv_id", "length", F.coalesce(F.col("first.depth") - 1, "length").alias("unowned"),
        F.coalesce("first.before", "all_bytes").alias("unowned_bytes"), F.coalesce("end.leaf", F.lit(False)).alias("leaf"),
    ))
    told = _dealt(rows.drop("bytes").join(facts, "conv_id")).mapInArrow(
        lambda batches: _subtrees(batches, chunk), "depth bigint, k1 bigint, k2 bigint, n_children bigint, n_leaves bigint, saved bigint"
    )
    trees = told.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
    return _joined(nodes, trees, found, facts, conversations)


def _joined(nodes: DataFrame, trees: DataFrame, found: DataFrame, facts: DataFrame, conversations: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    every = conversations.join(facts, "conv_id", "left")
    root = every.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.when((F.col("length") > 0) & (F.col("unowned") == 0), 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"), F.sum("unowned_bytes").alias("saved"),
    ).where("n_convs > 0")
    root = cut_lineage(root.select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
        "n_children", F.greatest(F.coalesce("n_leaves", zero), F.lit(1)).alias("n_leaves"), F.coalesce("saved", zero).alias("saved"),
    ))
    top = root.first()
    if top is None:
        return root.withColumn("ends_sha256", F.lit(EMPTY))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    lower = nodes.where("depth > 1").join(above, ["depth", "up1", "up2"])
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top.conv_id).cast("bigint"))
    told = lower.unionByName(first.select(*lower.columns)).join(trees, KEY).select(*root.columns).unionByName(root)
    ends = found.select(*KEY, F.explode("ends").alias("conv_id"))
    bare = conversations.join(facts.select("conv_id"), "conv_id", "left_anti").select(*[zero.alias(c) for c in KEY], "conv_id")
    ends = ends.unionByName(bare).repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    hashes = ends.mapInArrow(_end_hashes, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    return told.join(hashes, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def conversation_trie(conversations: DataFrame, width: int = BAND, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the rebuilt conversations."""
    turns, listed = rebuilt_turns(cut_lineage(ordered_turns(conversations)))
    nodes = prefix_nodes(turns, listed, width, chunk)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint"), F.col("n_leaves").cast("bigint"),
        F.col("saved").cast("bigint").alias("saved_tokens"), "ends_sha256",
    )
