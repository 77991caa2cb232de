"""SimHash near duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions.  Two fingerprints that differ in at most two bits differ in at most two
bytes, so they share at least six of their eight positional bytes.  Posting lists of single positional bytes would be as
long as the corpus is large.  The index therefore posts every distinct fingerprint under each choice of six positional
bytes (28 lists): a pair meets in a list exactly if its shared bytes reach the guaranteed minimum.  Within a list the shared
positional bytes of a pair are tallied, pairs below the minimum are left out, and the rest are verified bit by bit.  Fingerprints
of one list differ in two bytes only, so no list holds more than 65,536 of them; long lists look up the 136 patterns
of one or two flipped bits instead of comparing pairs, and hand on a spanning forest of their links.

Copies share a fingerprint and take part once.  Texts without words have fingerprint zero and are linked like any other.  Null
texts count as empty.  Rows that share a ``doc_id`` are fingerprinted one by one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.llm.components import connected_components
from turnsift.llm.words import byte_texts, map_arrow, space_words
from turnsift.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 2
POSITIONS = 8
LEAST_SHARED = POSITIONS - MAX_BITS
#: The positions that each list leaves out.
LEFT_OUT = list(combinations(range(POSITIONS), MAX_BITS))
LONG_LIST = 64
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    words = space_words(text)
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = words[at : at + CHUNK + SHINGLE - 1]
        if len(words) < SHINGLE:
            shingles = [b" ".join(words)]
        else:
            shingles = [b"%b %b %b" % x for x in zip(some, some[1:], some[2:])]
        hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (a hash of id and text) and ``fingerprint`` as a signed 64-bit integer."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = pa.array([fingerprint(t) for t in byte_texts(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), prints], ["doc_id", "row", "fingerprint"])

    rows = documents.select("doc_id", F.col("text").cast("string"), row_hash().alias("row"))
    return map_arrow(rows, scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row bigint, fingerprint bigint")


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def postings(prints: DataFrame) -> DataFrame:
    """Each distinct fingerprint under its 28 choices of six positional bytes: ``list``, ``shared``, ``fingerprint``."""
    lists = F.array(*[
        F.struct(
            F.lit(k).cast("tinyint").alias("list"),
            F.col("fingerprint").bitwiseAND(F.lit(_signed(~_byte_mask(out) & (2**64 - 1))).cast("bigint")).alias("shared"),
            F.col("fingerprint"),
        )
        for k, out in enumerate(LEFT_OUT)
    ])
    return prints.select(F.inline(lists))


def _verified(lists: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes, differ in few enough bits, and belong to this list.

    A pair with seven shared bytes meets in seven lists; it counts in the one that leaves out the lowest other position.
    """
    differs = a ^ b
    tally = np.zeros(len(a), np.int8)
    changed = np.zeros(len(a), np.int8)
    for p in range(POSITIONS):
        same = (differs >> np.uint64(8 * p)) & np.uint64(0xFF) == 0
        tally += same
        changed[~same] = p
    out = np.array(LEFT_OUT, np.int8)[lists]
    other = np.where(out[:, 0] == changed, out[:, 1], out[:, 0])
    own = (tally < POSITIONS - 1) | (other == (changed == 0))
    return (tally >= LEAST_SHARED) & own & (np.bitwise_count(differs) <= MAX_BITS)


def _short_lists(lists: np.ndarray, group: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = np.arange(len(prints))
    step = 1
    while True:
        at = at[at + step < len(prints)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        good = _verified(lists[at], prints[at], prints[at + step])
        yield prints[at][good], prints[at + step][good]
        step += 1


def _long_list(number: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links of one list, found through its members' 16 free bits."""
    low, high = (np.uint64(8 * p) for p in LEFT_OUT[number])
    free = ((prints >> low) & np.uint64(0xFF)) | (((prints >> high) & np.uint64(0xFF)) << np.uint64(8))
    place = np.full(1 << 16, -1)
    place[free.astype(np.int64)] = np.arange(len(prints))
    flips = [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]
    top = list(range(len(prints)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for flip in flips:
        to = place[(free ^ np.uint64(flip)).astype(np.int64)]
        at = np.flatnonzero(to > np.arange(len(prints)))
        good = _verified(np.full(len(at), number), prints[at], prints[to[at]])
        for x, y in zip(at[good].tolist(), to[at][good].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                top[max(rx, ry)] = min(rx, ry)
                kept.append((x, y))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    yield prints[pairs[:, 0]], prints[pairs[:, 1]]


def _list_links(lists: np.ndarray, shared: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole lists, whose rows stand together."""
    new = np.append(True, (lists[1:] != lists[:-1]) | (shared[1:] != shared[:-1]))
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    short = (sizes <= LONG_LIST)[group] & (sizes > 1)[group]
    yield from _short_lists(lists[short], group[short], prints[short])
    starts = np.flatnonzero(new)
    for g in np.flatnonzero(sizes > LONG_LIST):
        some = slice(starts[g], starts[g] + sizes[g])
        yield from _long_list(int(lists[starts[g]]), prints[some])


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that connect all fingerprints within two bits of each other."""
    posted = postings(prints.select("fingerprint").distinct())
    posted = posted.repartition("list", "shared").sortWithinPartitions("list", "shared", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in _list_links(*columns) if len(columns[0]) else ():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            now = [
                batch.column("list").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("shared").to_numpy(),
                batch.column("fingerprint").to_numpy().view(np.uint64),
            ]
            rows = [np.concatenate(x) for x in zip(rest, now)]
            if not len(rows[0]):
                continue
            # The last list may go on in the next batch.
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            yield from found([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        yield from found(rest)

    return posted.mapInArrow(run, "a bigint, b bigint")


def _grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``fingerprint, root`` of the distinct ones."""
    prints = cut_lineage(fingerprints(documents))
    roots = connected_components(links(prints)).withColumnRenamed("node", "fingerprint")
    own = prints.select("fingerprint").distinct().join(roots, "fingerprint", "left")
    return prints, cut_lineage(own.select("fingerprint", F.coalesce("root", "fingerprint").alias("root")))


def _per_group(prints: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """``root, least``: the smallest value over all rows of each group, copies first combined by fingerprint."""
    firsts = prints.groupBy("fingerprint").agg(F.min(least).alias("least"))
    return firsts.join(roots, "fingerprint").groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest ``doc_id`` reachable."""
    prints, roots = _grouped(documents)
    classes = roots.join(_per_group(prints, roots, F.col("doc_id")), "root")
    return prints.join(classes.drop("root"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def one_per_group(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id; a row without an id only if no other has one."""
    prints, roots = _grouped(documents)
    least = _per_group(prints, roots, F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    chosen = least.select(F.col("least.doc_id").alias("_id"), F.col("least.row").alias("_kept"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_kept"))
    kept = documents.withColumn("_hash", row_hash()).join(chosen, same, "left_semi")
    copies = prints.groupBy("doc_id", "row").count().where("count > 1")
    return (kept if copies.isEmpty() else kept.dropDuplicates(["doc_id", "_hash"])).drop("_hash")
