"""Repeated substrings by external induced sorting of suffixes.

Every byte is marked that lies in a string of ``LENGTH`` bytes which starts at another place too, in the same or another
document.  As in induced suffix sorting only a sample of suffixes is sorted by content, and what holds for the suffixes
between them is induced to the left, carrying suffix tuples and common-prefix values.

1. **Sample.** Among the positions where the first ``CORE`` bytes of a suffix fit into a window of ``LENGTH`` bytes, the one
   whose next eight bytes hash lowest is the anchor of the window.  Equal windows have equal anchors, and an anchor owns a run
   of neighbouring windows.  Anchors are the sampled suffixes, about one in seventy bytes.
2. **Naming.** An anchor is named by the hash of its core and of its context, the bytes of all windows it owns.  Counts of names
   settle most anchors at once: contexts seen twice are repeated throughout, cores seen once hold no repeated window.
3. **Sorting.** Anchors that share a core but not a context are sorted by the bytes behind them.  The queue is Spark's
   own sorter, which spills to disk, so a shard may be far larger than memory; suffix tuples leave it in order.
4. **Induction.** The longest common prefix with the suffix before is taken once per tuple.  The suffix that starts d bytes further
   left is then ordered by the d bytes to the left and by the rank among prefixes of LENGTH - d bytes, which the
   common-prefix values give.  Tuples that agree in both start equal windows.
5. **Recursion.** A core with more than ``GROUP`` different contexts is not sorted in one task.  Its windows are dealt to halves
   of their offsets, which have longer cores, and go through naming and sorting again, down to single windows.  Copies are merged by
   counting in each round, so no group grows with the data, and no row is left out.

Nulls are empty texts; texts shorter than ``LENGTH`` hold no window.  Rows that share a ``doc_id`` are told apart by their texts;
equal rows are copies of each other.  Names are 128 bits of hashes; sorted tuples are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.llm import bloom
from turnsift.llm.words import byte_texts, map_arrow
from turnsift.session import cut_lineage

LENGTH = 200
CORE = 64
OFFSETS = LENGTH - CORE + 1
GROUP = 20_000
STRETCH = 1 << 22

INTERVAL = "doc_id bigint, text_hash bigint, first bigint, last bigint"
TUPLE = "key bigint, name bigint, doc_id bigint, text_hash bigint, first bigint, offset int, context binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash(data: bytes, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data, seed))


def anchors(text: bytes) -> Iterator[tuple[int, int, int]]:
    """Anchor position, first and last window of each run of windows.

    A long text is taken in stretches of windows; a run cut there becomes two runs of the same core.
    """
    for start in range(0, len(text) - LENGTH + 1, STRETCH):
        part = text[start : start + STRETCH + LENGTH - 1]
        n = len(part) - CORE + 1
        grams = np.empty(n, "<u8")
        for i in range(min(8, n)):
            some = grams[i::8]
            some[:] = np.frombuffer(part, "<u8", len(some), i)
        mixed = (grams * np.uint64(0x9E3779B97F4A7C15)) ^ (grams >> np.uint64(29))
        order = (mixed * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(n, dtype=np.uint64)
        size = 1
        while 2 * size <= OFFSETS:
            order = np.minimum(order[:-size], order[size:])
            size *= 2
        windows = n - OFFSETS + 1
        least = np.minimum(order[:windows], order[OFFSETS - size : OFFSETS - size + windows])
        lowest = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(lowest, prepend=-1))
        last = np.append(first[1:], windows) - 1
        yield from zip((lowest[first] + start).tolist(), (first + start).tolist(), (last + start).tolist())


def _named(text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """Key, name, anchor, first and last window."""
    for at, first, last in anchors(text):
        yield _hash(text[at : at + CORE]), _hash(text[first : last + LENGTH], 1), at, first, last


def _document() -> Column:
    """``doc_id`` without nulls, for joins; ``text_hash`` tells a null apart."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))


def identified(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.withColumn("text", text).withColumn("text_hash", F.xxhash64("doc_id", "text"))


def _names(rows: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """``doc_id, text_hash, key, name, n``: the names of each document with their counts.

    With ``known``, a Bloom filter of (key, name), only names that may be in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            who = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            for (doc, text_hash), text in zip(who, byte_texts(batch.column("text"))):
                counts: dict[tuple[int, int], int] = {}
                for key, name, *_ in _named(text):
                    counts[key, name] = counts.get((key, name), 0) + 1
                for (key, name), n in counts.items():
                    for column, value in zip(out, (doc, text_hash, key, name, n)):
                        column.append(value)
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], ["doc_id", "text_hash", "key", "name", "n"]
            )
            if known is not None:
                keys = bloom.keys_of(found.column("key").to_numpy(), found.column("name").to_numpy())
                found = found.filter(pa.array(bloom.holds(known.value, keys)))
            yield found

    return rows.select("doc_id", "text_hash", "text").mapInArrow(
        run, "doc_id bigint, text_hash bigint, key bigint, name bigint, n bigint"
    )


def _of_documents(rows: DataFrame, known: Broadcast, wanted: bool = True) -> DataFrame:
    """Rows whose ``text_hash`` may be in the filter ``known``, or those that are not in it for sure."""

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(known.value, bloom.keys_of(hashes.to_numpy())))

    return rows.where(held("text_hash") if wanted else ~held("text_hash"))


def _counted(names: DataFrame, n: Column, who: Column) -> DataFrame:
    """Names that occur twice or share their key: ``key, name, n, chosen, variants``."""
    seen = names.groupBy("key", "name").agg(F.sum(n).alias("n"), F.min(who).alias("chosen"))
    keys = seen.groupBy("key").agg(F.count("*").alias("variants"), F.sum("n").alias("total")).where("total > 1")
    return cut_lineage(seen.join(keys.drop("total"), "key"))


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring and overlapping intervals of windows as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _placed(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """Intervals (``context`` null) and open tuples of the documents in ``needs``, found in their texts."""
    wanted = needs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "name", "whole", "variants")).alias("names"))
    both = rows.select("doc_id", "text_hash", "text").join(wanted, ["doc_id", "text_hash"])
    kinds = pa.schema([
        ("key", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()),
        ("offset", pa.int32()), ("context", pa.binary()), ("last", pa.int64()), ("variants", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            names = batch.column("names")
            out: list[tuple] = []
            size = 0
            for k, ((doc, text_hash), text) in enumerate(zip(who, byte_texts(batch.column("text")))):
                whole, open_ = set(), {}
                for x in names[k].as_py():
                    if x["whole"]:
                        whole.add((x["key"], x["name"]))
                    if x["variants"] > 1:
                        open_[x["key"], x["name"]] = x["variants"]
                found = []
                for key, name, at, first, last in _named(text):
                    if (key, name) in whole:
                        found.append((first, last))
                    variants = open_.pop((key, name), 0)
                    if variants:
                        out.append((key, name, doc, text_hash, first, at - first, text[first : last + LENGTH], None, variants))
                        size += last + LENGTH - first
                out += [(None, None, doc, text_hash, a, None, None, b, None) for a, b in _joined(found)]
                if size > STRETCH:
                    yield _batch(out, kinds)
                    out, size = [], 0
            yield _batch(out, kinds)

    return both.mapInArrow(run, f"{TUPLE}, last bigint, variants bigint")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rectangle(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    lengths = np.array([len(p) for p in parts])
    table = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    return table, lengths


def _classes(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of the distinct rows of ``columns``."""
    number = columns[0]
    for column in columns[1:]:
        number = np.unique(number * (int(column.max()) + 1) + column, return_inverse=True)[1]
    return number


def induce(keys: np.ndarray, offsets: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For suffix tuples in the order of key and following bytes: which windows, by offset, occur in two tuples.

    Gives a table of tuples by offsets; offset d is the window that starts d bytes before the suffix.
    """
    n = len(contexts)
    behind, behind_size = _rectangle([c[o:] for c, o in zip(contexts, offsets.tolist())], LENGTH)
    before, _ = _rectangle([c[:o][::-1] for c, o in zip(contexts, offsets.tolist())], OFFSETS)
    least = offsets - (np.array([len(c) for c in contexts]) - LENGTH)
    new = np.append(True, keys[1:] != keys[:-1])
    # Common prefix with the suffix before; zero where a key begins.
    differs = behind[1:] != behind[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common = np.append(0, np.minimum(common, np.minimum(behind_size[1:], behind_size[:-1])))
    common[new] = 0
    found = np.zeros((n, OFFSETS), bool)
    left = np.cumsum(new) - 1
    active = np.arange(n)
    for d in range(OFFSETS):
        rank = np.cumsum(common < LENGTH - d)
        own = (least[active] <= d) & (d <= offsets[active])
        at = active[own]
        if len(at):
            together = _classes(left[at], rank[at])
            found[at, d] = np.bincount(together)[together] > 1
        active = active[offsets[active] > d]
        if not len(active):
            break
        classes = _classes(left[active], before[active, d].astype(np.int64))
        left[active] = classes
        active = active[np.bincount(classes)[classes] > 1]
    return found


def _sorted_intervals(tuples: DataFrame) -> DataFrame:
    """Intervals of windows that occur in two tuples of one key; keys have a bounded number of tuples."""
    queue = tuples.select("key", "doc_id", "text_hash", "first", "offset", "context").withColumn(
        "behind", F.expr(f"substring(context, offset + 1, {LENGTH})")
    )
    queue = queue.repartition("key").sortWithinPartitions("key", "behind").drop("behind")

    def settle(rows: pa.Table) -> pa.RecordBatch:
        contexts = rows.column("context").to_pylist()
        offsets = rows.column("offset").to_numpy().astype(np.int64)
        found = induce(rows.column("key").to_numpy(), offsets, contexts)
        firsts = rows.column("first").to_numpy()
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        start = firsts[who] + offsets[who]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").combine_chunks().take(pa.array(who)), rows.column("text_hash").combine_chunks().take(pa.array(who)),
                pa.array(start - (high - 1)), pa.array(start - low),
            ],
            ["doc_id", "text_hash", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            held += batch.num_rows
            if held >= GROUP and keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield settle(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest, held = [batch.slice(cut)], batch.num_rows - cut
            else:
                rest.append(batch)
        if rest:
            yield settle(pa.Table.from_batches(rest))

    return queue.mapInArrow(run, INTERVAL)


def _halved(tuples: DataFrame, cells: int) -> DataFrame:
    """Tuples dealt to ``cells`` equal ranges of offsets, named by the bytes that all windows of a range share."""
    schema = pa.schema([
        ("key", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()),
        ("offset", pa.int32()), ("context", pa.binary()),
    ])
    width = -(-OFFSETS // cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                context, top = x["context"], x["offset"]
                low = top - (len(context) - LENGTH)
                for cell in range(low // width, top // width + 1):
                    a, b = max(low, cell * width), min(top, cell * width + width - 1)
                    shared = context[top - cell * width : top - (cell * width + width - 1) + LENGTH]
                    part = context[top - b : top - a + LENGTH]
                    out.append((
                        _hash(shared, 2 + cell), _hash(part, 1), x["doc_id"], x["text_hash"], x["first"] + top - b, b, part,
                    ))
            yield _batch(out, schema)

    return tuples.select("doc_id", "text_hash", "first", "offset", "context").mapInArrow(run, TUPLE)


def repeated_windows(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """Intervals ``first`` to ``last`` of window starts, per ``doc_id`` and ``text_hash``, that occur elsewhere too."""
    rows = identified(documents.select("doc_id", "text")).withColumn("doc_id", _document())
    counted = _counted(_names(rows), F.col("n"), F.col("text_hash"))
    known = rows.sparkSession.sparkContext.broadcast(bloom.gathered(counted, "key", "name"))
    named = _names(rows, known).drop("n").join(counted, ["key", "name"])
    open_ = F.when(F.col("text_hash") == F.col("chosen"), F.col("variants")).otherwise(F.lit(0)).alias("variants")
    needs = named.select("doc_id", "text_hash", "key", "name", (F.col("n") > 1).alias("whole"), open_)
    needs = cut_lineage(needs.where("whole or variants > 1"))
    # Texts are shuffled only where something was found in them.
    wanted = rows.sparkSession.sparkContext.broadcast(bloom.gathered(needs, "text_hash"))
    placed = cut_lineage(_placed(_of_documents(rows, wanted), needs))
    parts = [placed.where("context is null").select("doc_id", "text_hash", "first", "last")]
    open_ = placed.where("context is not null")
    cells = 1
    while True:
        parts.append(_sorted_intervals(open_.where(F.col("variants") <= group)))
        large = open_.where(F.col("variants") > group)
        if large.isEmpty():
            break
        cells = min(2 * cells, OFFSETS)
        tuples = cut_lineage(_halved(large, cells))
        counted = _counted(tuples, F.lit(1), F.struct("doc_id", "text_hash", "first"))
        named = tuples.join(counted, ["key", "name"])
        last = F.col("first") + F.octet_length("context") - LENGTH
        parts.append(named.where("n > 1").select("doc_id", "text_hash", "first", last.alias("last")))
        mine = F.struct("doc_id", "text_hash", "first") == F.col("chosen")
        open_ = cut_lineage(named.where(mine & (F.col("variants") > 1)).select(*tuples.columns, "variants"))
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    return windows


def with_repeats(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """``documents`` with ``windows``: intervals (first, last) of window starts that occur elsewhere too, in any order."""
    found = repeated_windows(documents, group)
    found = cut_lineage(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("windows")))
    rows = identified(documents.drop("windows")).withColumn("_doc", _document())
    found = found.withColumnRenamed("doc_id", "_doc")
    # Rows without a window stay where they are.
    known = rows.sparkSession.sparkContext.broadcast(bloom.gathered(found, "text_hash"))
    cut = _of_documents(rows, known).join(found, ["_doc", "text_hash"], "left").drop("_doc", "text_hash")
    whole = _of_documents(rows, known, False).drop("_doc", "text_hash")
    return cut.unionByName(whole.withColumn("windows", F.lit(None).cast(found.schema["windows"].dataType)))


def removed_ranges(windows: list[dict] | None) -> list[tuple[int, int]]:
    """Byte ranges, disjoint and apart, that the windows cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((w["first"], w["last"] + LENGTH) for w in windows or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for r in ranges for x in r], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut_repeats(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """``documents`` whose texts have lost the repeated bytes; of a cut character whatever is left is dropped, too."""
    rows = with_repeats(documents, group)
    schema = rows.drop("windows").schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        for k, windows in enumerate(batch.column("windows").to_pylist()):
            if windows:
                texts[k] = kept_bytes(texts[k].encode(), removed_ranges(windows)).decode(errors="ignore")
        yield pa.RecordBatch.from_pydict({
            f.name: pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields
        })

    return map_arrow(rows, run, schema)


def repeat_digests(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """Per document ``n_bytes, n_removed, n_spans, kept_sha256``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, windows in zip(byte_texts(batch.column("text")), batch.column("windows").to_pylist()):
            ranges = removed_ranges(windows)
            kept = kept_bytes(text, ranges)
            out.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )

    rows = with_repeats(documents.select("doc_id", "text"), group)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
