"""Spelling variants: words that differ by one code point, found by Bloom-guided neighbourhoods.

The vocabulary is counted over all texts, combined per task before it is shuffled.  From every word all results of deleting one code
point, or replacing one by a greater one, are generated as 64-bit hashes (an insertion is the deletion seen from the other word, a
replacement by a smaller code point the replacement seen from the other word).  They are probed against blocked Bloom filters of the
vocabulary, one per word length.  The filters are broadcast in passes of at most ``PASS_BLOCKS`` blocks (16 MB): lengths share a pass as long
as they fit, and a length with more words is split by hash into filters of several passes.  Only positives are shuffled, as two hashes, to
the join with the vocabulary, which together with a comparison of the two words removes all false ones.

A null text has no words; a null ``doc_id`` counts as an empty text in front of the colon of the hash that misspells.  Repeated rows
count again.  Texts and words may have any length.  Ties between forms go to the smallest word.  Without documents there are no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm import bloom
from turnsift.llm.components import _flattened
from turnsift.llm.words import map_arrow
from turnsift.session import cut_lineage

#: Fixed values of the contract.
EVERY, LEAST_SIZE, LEAST_COUNT, TIMES = 199, 6, 5, 5
RUN = re.compile("[a-zÀ-ÿ]+")
#: Longer words share one filter.
LONGEST = 64
PASS_BLOCKS = 1 << 21
CHUNK_BLOCKS = 1 << 12
HELD_WORDS = 100_000
HELD_BYTES = 16 << 20
STRETCH = 1 << 14
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUE = np.zeros(256, np.uint64)
_VALUE[LETTERS] = bloom.mix(LETTERS.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def text_words(doc_id: object, text: bytes) -> dict[str, int]:
    """The words of a text that are long enough, with how often they stand there."""
    runs: dict[str, int] = {}
    for run in RUN.findall(text.lower().decode("utf-8", "replace")):
        runs[run] = runs.get(run, 0) + 1
    head = zlib.crc32(b"%b:" % ("" if doc_id is None else str(doc_id)).encode())
    words: dict[str, int] = {}
    for run, n in runs.items():
        if len(run) < LEAST_SIZE:
            continue
        h = zlib.crc32(run.encode(), head)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_SIZE:
                continue
        words[run] = words.get(run, 0) + n
    return words


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    size = 0

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            for word, n in text_words(doc_id, text or b"").items():
                if word not in held:
                    size += len(word)
                held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS or size > HELD_BYTES:
                yield sums()
                held, size = {}, 0
    yield sums()


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the length of each word."""
    texts = words.to_pylist()
    flat = np.frombuffer("".join(texts).encode("latin-1"), np.uint8).astype(np.int64)
    return flat, np.array([len(t) for t in texts], np.int64)


def _powers(sizes: np.ndarray) -> np.ndarray:
    most = int(sizes.max(initial=0)) + 1
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(most, _BASE, np.uint64)))


def _key(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return bloom.mix(sums + sizes.astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def _places(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and place of every letter, what it adds to the sum of its word, and the sums."""
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - starts[word]
    adds = _VALUE[flat] * _powers(sizes)[place]
    return word, place, adds, np.add.reduceat(adds, starts) if len(sizes) else np.empty(0, np.uint64)


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, n, size, key`` of the words with enough code points and occurrences; ``key`` is their hash."""
    rows = documents.select("doc_id", F.col("text").cast("string"))
    counts = rows.mapInArrow(_partial_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, sizes = _letters(batch.column("word"))
        keys = _key(_places(flat, sizes)[3], sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.array(sizes), pa.array(keys.view(np.int64))], ["word", "n", "size", "key"]
        )

    return map_arrow(counts.where(F.col("n") >= LEAST_COUNT), keyed, "word string, n bigint, size bigint, key bigint")


def filter_plan(words_per_shard: dict[int, int], pass_blocks: int = PASS_BLOCKS) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """Passes of filters ``(shard, part): (parts of the shard, blocks)``; no pass has more than ``pass_blocks`` blocks."""
    passes: list[dict] = [{}]
    room = pass_blocks
    for shard, words in sorted(words_per_shard.items()):
        blocks = bloom.blocks_for(words)
        parts = max(1, blocks // pass_blocks)
        for part in range(parts):
            own = blocks // parts
            if own > room:
                passes.append({})
                room = pass_blocks
            passes[-1][shard, part] = (parts, own)
            room -= own
    return passes


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(54)) & np.uint64(parts - 1)


def build_filters(words: DataFrame, plan: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of a pass.  Chunks of 32 KB are built by grouping; the driver gets the filters, whose size is bounded, not the words."""
    order = sorted(plan)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column("key").to_numpy().view(np.uint64)
        shards = np.minimum(batch.column("size").to_numpy(), LONGEST)
        for number, (shard, part) in enumerate(order):
            parts, blocks = plan[shard, part]
            own = keys[(shards == shard) & (_part(keys, parts) == part)]
            chunk = (bloom._place(own, blocks)[0] // CHUNK_BLOCKS).astype(np.int32)
            filters = pa.array(np.full(len(own), number, np.int32))
            yield pa.RecordBatch.from_arrays([filters, pa.array(chunk), pa.array(own.view(np.int64))], ["filter", "chunk", "key"])

    def build(table: pa.Table) -> pa.Table:
        number, chunk = table["filter"][0].as_py(), table["chunk"][0].as_py()
        blocks = plan[order[number]][1]
        at, mask = bloom._place(table["key"].to_numpy().view(np.uint64), blocks)
        bits = np.zeros(min(blocks, CHUNK_BLOCKS), np.uint64)
        np.bitwise_or.at(bits, at - chunk * CHUNK_BLOCKS, mask)
        return pa.table({"filter": [number], "chunk": [chunk], "bits": [bits.tobytes()]}, pa.schema([("filter", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))

    dealt = map_arrow(words.select("key", "size"), place, "filter int, chunk int, key bigint").distinct()
    chunks = dealt.groupBy("filter", "chunk").applyInArrow(build, "filter int, chunk int, bits binary").toArrow()
    filters = {name: np.zeros(plan[name][1], np.uint64) for name in order}
    for number, chunk, bits in zip(*(chunks[c].to_pylist() for c in ("filter", "chunk", "bits"))):
        some = np.frombuffer(bits, np.uint64)
        filters[order[number]][chunk * CHUNK_BLOCKS : chunk * CHUNK_BLOCKS + len(some)] = some
    return filters


def _probe(keys: np.ndarray, shard: int, filters: dict, plan: dict) -> np.ndarray:
    """Which keys the filters of ``shard`` in this pass may hold."""
    found = np.zeros(len(keys), bool)
    for (own, part), bits in filters.items():
        if own == shard:
            parts = plan[own, part][0]
            at = slice(None) if parts == 1 else np.flatnonzero(_part(keys, parts) == part)
            found[at] = bloom.holds(bits, keys[at])
    return found


def neighbours(flat: np.ndarray, sizes: np.ndarray, filters: dict, plan: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positives of words that share a filter: (positions of words, keys of their edited forms)."""
    word, place, adds, sums = _places(flat, sizes)
    powers = _powers(sizes)
    shard = int(min(sizes[0], LONGEST))
    # Deleting a letter: what stands behind it moves one place to the front.
    through = np.cumsum(adds)
    before = through - adds - np.append(np.uint64(0), np.cumsum(sums)[:-1])[word]
    left = before + (sums[word] - before - adds) * _BACK
    keys = _key(left, sizes[word] - 1)
    hit = np.flatnonzero(_probe(keys, int(min(sizes[0] - 1, LONGEST)), filters, plan))
    yield word[hit], keys[hit]
    for at in range(0, len(flat), STRETCH):
        some = slice(at, at + STRETCH)
        letter, to = np.nonzero(LETTERS[None, :] > flat[some, None])
        letter += at
        changed = sums[word[letter]] - adds[letter] + _VALUE[LETTERS[to]] * powers[place[letter]]
        keys = _key(changed, sizes[word[letter]])
        hit = np.flatnonzero(_probe(keys, shard, filters, plan))
        yield word[letter[hit]], keys[hit]


def near_pairs(words: DataFrame, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``word, n, near, near_n`` for all words of a vocabulary that differ by one code point, in both directions."""
    spark = words.sparkSession
    counts = words.groupBy(F.least("size", F.lit(LONGEST)).cast("int").alias("shard")).count().collect()
    plans = [plan for plan in filter_plan({r["shard"]: r["count"] for r in counts}, pass_blocks) if plan]
    positives = []
    for plan in plans:
        filters = spark.sparkContext.broadcast(build_filters(words, plan))

        def scan(batch: pa.RecordBatch, filters=filters, plan=plan) -> Iterator[pa.RecordBatch]:
            flat, sizes = _letters(batch.column("word"))
            starts = np.cumsum(sizes) - sizes
            own = batch.column("key").to_numpy()
            # Words of one length, or all longer ones, look into the same filters.
            same = np.minimum(sizes, LONGEST + 1)
            for size in np.unique(same).tolist():
                chosen = np.flatnonzero(same == size)
                letters = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in chosen])
                for at, keys in neighbours(letters, sizes[chosen], filters.value, plan):
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(own[chosen[at]]), pa.array(keys.view(np.int64))], ["a", "b"])

        positives.append(cut_lineage(map_arrow(words.select("word", "key"), scan, "a bigint, b bigint").distinct()))
    if not positives:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where(F.lit(False))
    found = positives[0]
    for more in positives[1:]:
        found = found.unionByName(more)
    there = words.select(F.col("key").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    here = words.select(F.col("key").alias("a"), "word", "n")
    pairs = found.join(there, "b").join(here, "a").where(F.levenshtein("word", "near", 1) == 1)
    ends = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(ends))


def variant_groups(documents: DataFrame, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary of ``documents``."""
    words = cut_lineage(vocabulary(documents))
    # The most frequent near word, the smallest of equals.
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, pass_blocks).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.select("word", "n").join(near, "word", "left")
    takes = -F.col("best.n") >= TIMES * F.col("n")
    formed = cut_lineage(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"),
    ))
    roots = _flattened(formed.select(F.col("word").alias("node"), F.coalesce("form", "word").alias("parent")))
    roots = roots.select(F.col("node").alias("word"), F.col("parent").alias("root"))
    return formed.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
