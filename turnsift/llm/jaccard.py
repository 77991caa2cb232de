"""Jaccard join of n-gram sets by vertical partitioning.

A document is the set of its distinct three-word shingles, each a 64-bit hash.  The global order of n-grams is the order of
their hashes, so even pivots cut it into fragments of equal expected load.  The join works on fragments only:

* *Candidates.*  Two sets of s and t n-grams with a Jaccard index of 0.9 or more differ in at most (s + t) / 19 n-grams.  An
  order cut into more fragments than that leaves at least one fragment in which both have the same n-grams, so sets meet where
  their segments of one fragment are equal.  The number of fragments follows from the size, in classes of sizes a factor of
  1.5 apart; a set also takes part in the class of sets larger than itself that it may link to.  Sets with too many empty
  segments to be sure of a common one that is not empty go through further orders, and after those through the prefix filter.
* *Filters.*  Candidates must pass the length bound and a bound by 256 parity bits: the bits of two sets differ in no more places
  than the sets do.
* *Counting.*  The order is cut into 8 fragments.  The overlap of a pair is counted in each of them separately, by joins of (pair,
  fragment) with the segments, and summed per pair.

Equal sets are one class and take part once.  A long list of candidates is compared with its hub first, the class that shares most
segments.  What is still in different components then is compared in blocks of 2,048 by 2,048.  So a group of copies of any
size costs a number of rows in proportion to it, no link is lost, and nothing is collected.

Hashes stand for n-grams: within one set or pair two of them collide with a chance of about n² / 2^65; class ids have 64 bits too.
Null and empty texts have no set, are linked with nothing, and are their own component.  Fewer than three words are one shingle.
Rows that share a ``doc_id`` are compared one by one.  Texts of any length are read whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm import bloom
from turnsift.llm.components import connected_components
from turnsift.llm.words import byte_texts, map_arrow, space_words
from turnsift.session import cut_lineage

SHINGLE = 3
#: Least Jaccard index as a fraction; sets of sizes s and t may differ in (s + t) * (WHOLE - PART) // (WHOLE + PART) n-grams.
PART, WHOLE = 9, 10
#: Vertical fragments in which overlaps are counted: the highest three bits of the hash.
FRAGMENT_BITS = 3
#: Orders tried before the prefix filter.
ORDERS = 4
PARITY_BITS = 256
SHORT_LIST = 32
BLOCK = 2048
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _most_different(s, t):
    return (s + t) * (WHOLE - PART) // (WHOLE + PART)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    size = min(SHINGLE, len(hashes))
    count = len(hashes) - size + 1
    mixed = np.full(count, size, np.uint64)
    for i in range(size):
        mixed = bloom.mix(mixed + hashes[i : i + count] * _FACTORS[i])
    return np.unique(mixed)


def _classes(n: int) -> list[tuple[int, int]]:
    """(number, largest size) of the size classes that a set of ``n`` takes part in."""
    most, number, out = n * WHOLE // PART, 0, []
    size = 2 * WHOLE - 1
    while True:
        if size >= n:
            out.append((number, size))
        if size >= most:
            return out
        number, size = number + 1, size * 3 // 2


def _segment_keys(order: np.ndarray, grams: np.ndarray, parts: int, tag: int) -> tuple[np.ndarray, int]:
    """A key for each segment that is not empty, and how many are empty.  ``order`` is sorted; ``grams`` in the same order."""
    part = ((order >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sums = np.add.reduceat(bloom.mix(grams), starts)
    names = part[starts] + np.uint64(tag) * np.uint64(1 << 34)
    return bloom.mix(bloom.mix(sums) + names), parts - len(starts)


def candidate_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of which any two different sets that link have one in common."""
    n = len(grams)
    found = [np.empty(0, np.uint64)]
    if _most_different(n, n * WHOLE // PART) == 0:
        return found[0]
    for number, size in _classes(n):
        most = _most_different(size, size)
        parts = most + 2 + most // 64
        for turn in range(ORDERS):
            order, some = grams, grams
            if turn:
                order = bloom.mix(grams + np.uint64(turn) * _FACTORS[0])
                at = np.argsort(order)
                order, some = order[at], grams[at]
            keys, empty = _segment_keys(order, some, parts, number * (ORDERS + 1) + turn)
            found.append(keys)
            if empty < parts - most:
                break
        else:
            tag = number * (ORDERS + 1) + ORDERS
            prefix = grams[: n - -(-n * PART // WHOLE) + 1]
            found.append(bloom.mix(bloom.mix(prefix) + np.uint64(tag) * np.uint64(1 << 34)))
    return np.concatenate(found)


def _parity(grams: np.ndarray) -> list[int]:
    odd = np.bincount((grams & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def gram_sets(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (a hash of id and text), ``n_shingles``, ``set`` (its 64-bit class; null without words), ``keys``, ``parity``."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, ids, keys, parity = [], [], [], []
        for text in byte_texts(batch.column("text")):
            grams = shingles(text)
            sizes.append(len(grams))
            ids.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None)
            keys.append(candidate_keys(grams).view(np.int64) if len(grams) else [])
            parity.append(_parity(grams))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())),
            ],
            ["doc_id", "row", "n_shingles", "set", "keys", "parity"],
        )

    rows = _rows(documents)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, scan, f"doc_id {kind}, row bigint, n_shingles bigint, set bigint, keys array<bigint>, parity array<bigint>")


def _rows(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row"))


def shared_keys(classes: DataFrame) -> DataFrame:
    """``key, set`` of the keys that several classes have."""
    posted = classes.select(F.explode("keys").alias("key"), "set")
    posted = posted.repartition("key").sortWithinPartitions("key", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row waits for the next batch, with the key of the row before it.
        key, owner, before = np.empty(0, np.int64), np.empty(0, np.int64), None

        def kept(last: bool) -> pa.RecordBatch:
            nonlocal key, owner, before
            new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
            key, owner = key[new], owner[new]
            same = key[1:] == key[:-1]
            many = np.append(before == key[0], same) | np.append(same, False)
            done = len(key) - (not last)
            batch = pa.RecordBatch.from_arrays([pa.array(key[:done][many[:done]]), pa.array(owner[:done][many[:done]])], ["key", "set"])
            before = int(key[-2]) if len(key) > 1 else before
            key, owner = key[done:], owner[done:]
            return batch

        for batch in batches:
            key = np.append(key, batch.column("key").to_numpy())
            owner = np.append(owner, batch.column("set").to_numpy())
            if len(key):
                yield kept(last=False)
        if len(key):
            yield kept(last=True)

    return posted.mapInArrow(run, "key bigint, set bigint")


def _may_link(n: np.ndarray, parity: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    fits = small * WHOLE >= large * PART
    bits = np.zeros(len(a), np.int64)
    for column in parity.T:
        bits += np.bitwise_count(column[a] ^ column[b])
    return fits & (bits <= _most_different(n[a], n[b]))


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parity = table["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_BITS // 64)
    return table["key"].to_numpy(), table["set"].to_numpy(), table["n_shingles"].to_numpy(), parity


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _list_pairs(table: pa.Table, goes_on: bool, short: int) -> pa.RecordBatch:
    """Pairs of the lists of ``table``, whose first row is the hub of a long list if that one ``goes_on``."""
    key, owner, n, parity = _members(table)
    new = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    sizes[0] += short if goes_on else 0
    hub, at = np.flatnonzero(new)[group], np.flatnonzero(~new)
    a, b = [hub[at]], [at]
    at = np.flatnonzero((sizes > 2)[group] & (sizes <= short)[group] & ~new)
    for step in range(1, short - 1):
        at = at[at + step < len(key)]
        at = at[group[at] == group[at + step]]
        a.append(at)
        b.append(at + step)
    a, b = np.concatenate(a), np.concatenate(b)
    good = _may_link(n, parity, a, b)
    return _pairs(owner[a[good]], owner[b[good]])


def hub_pairs(members: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """Pairs ``a, b`` of short lists, and of each long list those with its hub, that pass the filters."""
    listed = members.repartition("key").sortWithinPartitions("key", F.col("weight").desc(), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last list may go on in the next batch: a short one waits, of a long one the hub is kept.
        rest, goes_on = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table["key"].to_numpy()
            start = int(np.flatnonzero(key == key[-1])[0])
            continued = goes_on and start == 0
            if continued or len(key) - start > short:
                yield _list_pairs(table, goes_on, short)
                rest, goes_on = table.slice(start, 1), True
            else:
                if start:
                    yield _list_pairs(table.slice(0, start), goes_on, short)
                rest, goes_on = table.slice(start), False
        if rest is not None and not goes_on:
            yield _list_pairs(rest, False, short)

    return listed.select("key", "set", "n_shingles", "parity").mapInArrow(run, "a bigint, b bigint").distinct()


def _open_lists(members: DataFrame, roots: DataFrame, short: int) -> DataFrame:
    """Rows of the long lists whose members are not all in one component, with ``root`` and the list's ``size``."""
    named = roots.select(F.col("node").alias("set"), "root")
    placed = members.join(named, "set", "left").withColumn("root", F.coalesce("root", "set"))
    lists = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    lists = lists.where((F.col("size") > short) & (F.col("lo") < F.col("hi"))).select("key", "size")
    return placed.join(lists, "key")


def block_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of different components in the lists of ``_open_lists`` that pass the filters, compared block by block."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    # A block meets every block from its own on: rows are sent once to each such pair of blocks.
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), own.alias("mine")))
    dealt = members.select("key", "set", "n_shingles", "parity", "root", F.inline(others))
    return dealt.groupBy("key", "i", "j").applyInArrow(_compare, "a bigint, b bigint").distinct()


def _compare(table: pa.Table) -> pa.Table:
    _, owner, n, parity = _members(table)
    root, mine = table["root"].to_numpy(), table["mine"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in left:
        to = right[(root[right] != root[x]) & ((i != j) | (right > x))]
        to = to[_may_link(n, parity, np.full(len(to), x), to)]
        a.append(np.full(len(to), owner[x]))
        b.append(owner[to])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def segments(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set, n, fragment, grams`` of the classes of ``wanted`` (``row, set``), from one row of each.

    A Bloom filter of the rows, of a fixed size, is broadcast, so that texts are read where they lie; the join behind it is exact.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bloom.gathered(wanted, "row"))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(bloom.holds(shared.value, bloom.keys_of(batch.column("row").to_numpy()))))
        rows, fragments, grams = [], [], []
        for row, text in zip(batch.column("row").to_pylist(), byte_texts(batch.column("text"))):
            own = shingles(text)
            fragment = (own >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
            cuts = np.searchsorted(fragment, np.arange((1 << FRAGMENT_BITS) + 1))
            for f in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                rows.append(row)
                fragments.append(f)
                grams.append(own[cuts[f] : cuts[f + 1]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(fragments, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["row", "fragment", "grams"]
        )

    cut = map_arrow(_rows(documents).select("row", "text"), scan, "row bigint, fragment int, grams array<bigint>")
    # A repeated row gives its segments once.
    return cut.join(wanted, "row").groupBy("set", "fragment").agg(F.first("grams").alias("grams"))


def verified(pairs: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link: overlaps counted per fragment and summed per pair."""
    left = parts.select(F.col("set").alias("a"), "fragment", F.col("grams").alias("here"))
    right = parts.select(F.col("set").alias("b"), "fragment", F.col("grams").alias("there"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", F.size(F.array_intersect("here", "there")).cast("bigint").alias("common")
    )
    summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    n_a = sizes.select(F.col("set").alias("a"), F.col("n_shingles").alias("n_a"))
    n_b = sizes.select(F.col("set").alias("b"), F.col("n_shingles").alias("n_b"))
    all_of = F.col("n_a") + F.col("n_b") - F.col("common")
    return summed.join(n_a, "a").join(n_b, "b").where(F.col("common") * WHOLE >= all_of * PART).select("a", "b")


def _links(documents: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = cut_lineage(classes.select("set", "row").join(ends, "set"))
    parts = cut_lineage(segments(documents, wanted))
    return cut_lineage(verified(pairs, parts, classes.select("set", "n_shingles")))


def class_links(documents: DataFrame, sets: DataFrame, short: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between classes that connect all classes with a Jaccard index of at least 0.9."""
    classes = cut_lineage(sets.where("set is not null").select("set", "row", "n_shingles", "keys", "parity").dropDuplicates(["set"]))
    shared = cut_lineage(shared_keys(classes))
    weights = shared.groupBy("set").agg(F.count(F.lit(1)).alias("weight"))
    facts = classes.select("set", "n_shingles", "parity").join(weights, "set")
    members = cut_lineage(shared.join(facts, "set"))
    near = _links(documents, hub_pairs(members, short), classes)
    left = cut_lineage(_open_lists(members, connected_components(near), short))
    if left.isEmpty():
        return near
    return near.unionByName(_links(documents, block_pairs(left, block), classes))


def jaccard_components(documents: DataFrame, short: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` reachable by links, itself included."""
    sets = cut_lineage(gram_sets(documents))
    links = class_links(documents, sets, short, block)
    roots = connected_components(links).withColumnRenamed("node", "set")
    firsts = sets.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    firsts = cut_lineage(firsts.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    least = firsts.groupBy("root").agg(F.min("least").alias("component_id"))
    named = firsts.join(least, "root").select("set", "component_id")
    rows = sets.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
