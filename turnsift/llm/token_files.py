"""Token ids in fixed-width bit packing.

A token file is a folder of two Parquet tables:

* ``blocks``: one row per block of whole documents.  ``payload`` holds the ids one after the other, each in
  ``bits`` bits, lowest bit first, in little-endian 64-bit words.  ``doc_ids`` and ``offsets`` list the documents of the
  block and where each begins in it (one offset more than documents); ``shard`` and ``first`` place the block.
* ``shards``: per shard its first document, its number of ids and ``start``, the ids of all shards before it.

Ids are read back by vector shifts of 64-bit words, 64 ids at a time; any id of a block is found by its bit address alone, and a
document by the minimum and maximum ``doc_id`` that Parquet keeps of each block.

A document longer than a block has a block of its own.  Null texts are empty and get the end id only.  Rows that share
a ``doc_id`` follow each other in the order of their texts, rows without one come first.  An empty table gives empty files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnsift.llm.words import map_arrow

BLOCK_IDS = 1 << 18
PIECES = 1_000_000
#: Longer pieces are not kept; a million of the others takes at most some 300 MB.
LONG_PIECE = 48
STRETCH = 8 << 20
#: A space next to other white space, for the pattern library of Arrow.
UNSAFE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}] | [\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Pieces in one call of the library; in longer texts each piece takes up to twice the time.
TOGETHER = 100
#: Behind a letter the library takes a run of these apart from it.
MARKS = "!#$%&*,.:;?|"
BLOCKS = (
    "shard int, block int, first bigint, bits int, min_doc bigint, max_doc bigint, n_ids bigint, payload binary, "
    "doc_ids array<bigint>, offsets array<bigint>"
)


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def _lanes(bits: int) -> Iterator[tuple[int, int, int]]:
    """64 ids fill ``bits`` words: of each the word it begins in, its shift there, and the bits it leaves over."""
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        yield word, shift, max(0, shift + bits - 64)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each in little-endian 64-bit words, and one word more so that reads may overshoot."""
    rows = -(-len(ids) // 64)
    lanes = np.zeros((rows, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.T)
    words = np.zeros((bits + 1, rows), np.uint64)
    for values, (word, shift, over) in zip(lanes, _lanes(bits)):
        words[word] |= values << np.uint64(shift)
        if over:
            words[word + 1] |= values >> np.uint64(bits - over)
    used = (len(ids) * bits + 63) // 64
    return np.append(words[:bits].T.reshape(-1)[:used], np.uint64(0)).astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a payload; whole groups of 64 are taken apart lane by lane."""
    mask = np.uint64((1 << bits) - 1)
    if first % 64 == 0 and count >= 4096:
        rows = -(-count // 64)
        words = np.zeros(rows * bits, np.uint64)
        some = np.frombuffer(payload, "<u8")[first * bits // 64 :][: len(words)]
        words[: len(some)] = some
        words = np.ascontiguousarray(words.reshape(rows, bits).T)
        out = np.empty((64, rows), np.uint32)
        for lane, (word, shift, over) in enumerate(_lanes(bits)):
            values = words[word] >> np.uint64(shift)
            if over:
                values = values | (words[word + 1] << np.uint64(bits - over))
            out[lane] = values & mask
        return out.T.reshape(-1)[:count]
    words = np.frombuffer(payload, "<u8")
    at = np.arange(first, first + count, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((low | high) & mask).astype(np.uint32)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _short(pieces: Iterable[str], codes: Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """What is kept: no piece that is long, so that the number of pieces bounds what they take."""
    return (pair for pair in zip(pieces, codes) if len(pair[0]) <= LONG_PIECE)


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Encodes texts through their pieces between single spaces.

    A byte-level BPE with word splitting never joins a space between two non-spaces to what stands before it, so a text
    cut there is encoded piece by piece.  Marks behind a letter are tokens of their own and are looked up apart.  Known
    pieces are kept, in two halves of which the older one is dropped when the newer is full; new ones go to the library
    ``TOGETHER`` at a time, as one text, in which only the first token of a piece begins with a space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        # Texts with a control string go to the library whole: it takes the string for its token, wherever it stands.
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(code.ids, "<u4").tobytes() for code in codes]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces, without the space that stands before each."""
        codes: dict[str, bytes] = {}
        whole = [p for p in pieces if not p or " " in p]
        codes.update(zip(whole, self._library([" " + p for p in whole])))
        single = [p for p in pieces if p and " " not in p]
        for at in range(0, len(single), TOGETHER):
            some = single[at : at + TOGETHER]
            ids = self._library([" " + " ".join(some)])[0]
            starts = (np.flatnonzero(self.spaced[np.frombuffer(ids, "<u4")]) * 4).tolist()
            codes.update(zip(some, (ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)]))))
        self.known.update(_short(codes, codes.values()))
        return list(map(codes.__getitem__, pieces))

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that stand behind a space."""
        if len(self.known) > PIECES // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        missing = [at for at, code in enumerate(found) if code is None]
        for at in missing:
            code = self.older.get(pieces[at])
            if code is not None:
                found[at] = self.known[pieces[at]] = code
        missing = [at for at in missing if found[at] is None]
        for at, code in zip(missing, self._learn([pieces[at] for at in missing])):
            found[at] = code
        return found

    def _start_codes(self, kept: dict[str, bytes], pieces: list[str]) -> list[bytes]:
        """Ids of pieces without a space before them."""
        if len(kept) > PIECES // 10:
            kept.clear()
        new = [piece for piece in pieces if piece not in kept]
        codes = dict(zip(new, self._library(new)))
        found = [codes[piece] if piece in codes else kept[piece] for piece in pieces]
        kept.update(_short(codes, codes.values()))
        return found

    def _marked_codes(self, pieces: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct pieces that stand behind a space, those of marks behind a letter looked up apart."""
        cores = pc.ascii_rtrim(pieces, characters=MARKS)
        marked = pc.not_equal(pc.binary_length(cores), pc.binary_length(pieces))
        marked = pc.and_(marked, pc.match_substring_regex(cores, r"[a-zA-Z]\z"))
        cores = pc.if_else(marked, cores, pieces).dictionary_encode()
        codes = pa.array(self._codes(_strings(cores.dictionary)), pa.large_binary()).take(cores.indices)
        marks = pc.if_else(marked, pc.replace_substring_regex(pieces, r"(?s)\A.*[a-zA-Z]", ""), "").dictionary_encode()
        tails = pa.array(self._start_codes(self.tails, _strings(marks.dictionary)), pa.large_binary())
        return pc.binary_join_element_wise(codes, tails.take(marks.indices), pa.scalar(b"", pa.large_binary()))

    def _gathered(self, cut: pa.ListArray, end_id: int) -> list[np.ndarray]:
        """Texts as lists of pieces, single spaces between them: distinct ones are looked up once and copied by index."""
        if not len(cut):
            return []
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        pieces = cut.flatten()
        behind = np.ones(len(pieces), bool)
        behind[bounds[:-1]] = False
        rest = pieces.filter(pa.array(behind)).dictionary_encode()
        heads = pieces.take(pa.array(bounds[:-1])).dictionary_encode()
        starts = [*self._start_codes(self.heads, _strings(heads.dictionary)), np.uint32(end_id).astype("<u4").tobytes()]
        codes = [self._marked_codes(rest.dictionary), pa.array(starts, pa.large_binary())]
        piece = np.empty(len(pieces), np.int32)
        piece[behind] = rest.indices.to_numpy()
        piece[bounds[:-1]] = heads.indices.to_numpy() + len(codes[0])
        piece = np.insert(piece, bounds[1:], len(codes[0]) + len(starts) - 1)
        copied = pa.concat_arrays(codes).take(pa.array(piece))
        begins, ids = (np.frombuffer(part, kind) for part, kind in zip(copied.buffers()[1:], ("<i8", "<u4")))
        ends = begins[bounds[1:] + np.arange(1, len(bounds))] // 4
        return np.split(ids[: ends[-1]], ends[:-1])

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of each text, followed by ``end_id``."""
        odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False).astype(int)
        for control in self.controls:
            odd[pc.match_substring(texts, control).to_numpy(zero_copy_only=False)] = 2
        plain, apart, whole = (texts.filter(pa.array(odd == kind)) for kind in range(3))
        lists = pa.array([self.cut.split(text) for text in apart.to_pylist()], pa.list_(pa.string()))
        coded = (
            iter(self._gathered(pc.split_pattern(plain, " "), end_id)),
            iter(self._gathered(lists, end_id)),
            (np.append(np.frombuffer(c, "<u4"), np.uint32(end_id)) for c in self._library(whole.to_pylist())),
        )
        return [next(coded[kind]) for kind in odd.tolist()]


@cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _stretches(texts: pa.Array) -> Iterator[slice]:
    """Rows that hold about ``STRETCH`` bytes together, or one longer text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + STRETCH, "right")))
        yield slice(at, to)
        at = to


def _blocks(shard: int, bits: int, documents: Iterator[tuple[int, np.ndarray]]) -> Iterator[dict]:
    ids: list[np.ndarray] = []
    names: list[int] = []
    block = first = size = 0

    def made() -> dict:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        known = [name for name in names if name is not None] or [None]
        return {
            "shard": shard, "block": block, "first": first, "bits": bits, "min_doc": known[0], "max_doc": known[-1],
            "n_ids": size, "payload": pack(np.concatenate(ids), bits), "doc_ids": names, "offsets": offsets.tolist(),
        }

    for name, codes in documents:
        if names and size + len(codes) > BLOCK_IDS:
            yield made()
            block, first, size = block + 1, first + size, 0
            ids, names = [], []
        ids.append(codes)
        names.append(name)
        size += len(codes)
    if names:
        yield made()


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 0) -> None:
    """Tokenizes all texts, ``end_id`` after each document, and writes them in ascending ``doc_id`` order."""
    bits = bits_for(vocabulary)
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("shard", F.spark_partition_id())
    # Sorted rows arrive in batches: a batch at a time is encoded, blocks run across batches.
    schema = spark.createDataFrame([], BLOCKS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[int] = []

        def coded() -> Iterator[tuple[int, np.ndarray]]:
            encoder = _encoder(tokenizer)
            for batch in batches:
                shards[:] = batch.column("shard")[:1].to_pylist()
                names = batch.column("doc_id").to_pylist()
                texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
                for some in _stretches(texts):
                    yield from zip(names[some], encoder.encode(texts[some], end_id))

        for block in _blocks(0, bits, coded()):
            block["shard"] = shards[0]
            yield pa.RecordBatch.from_pylist([block], pa_schema)

    pa_schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("bits", pa.int32()),
        ("min_doc", pa.int64()), ("max_doc", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
    ])
    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.min("min_doc").alias("min_doc"), F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint"))  # one row per shard
    shards.withColumn("start", start).write.parquet(f"{folder}/shards")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks, with ``start``: the ids of all blocks before each."""
    blocks = spark.read.schema(spark.createDataFrame([], BLOCKS).schema).parquet(f"{folder}/blocks")
    shards = spark.read.schema("shard int, min_doc bigint, n_ids bigint, start bigint").parquet(f"{folder}/shards")
    at = shards.select("shard", F.col("start").alias("_start"))
    return blocks.join(at, "shard").withColumn("start", F.col("_start") + F.col("first")).drop("_start")


def document_ids(block: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """``doc_id``, offset in the block and ids of each document of a block."""
    ids = unpack(block["payload"], block["bits"], 0, block["n_ids"]).astype("<u4", copy=False)
    offsets = block["offsets"]
    for name, a, b in zip(block["doc_ids"], offsets, offsets[1:]):
        yield name, a, ids[a:b]


def token_digests(blocks: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, read back from the blocks."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in batch.to_pylist():
            rows = [(n, block["start"] + a, len(x), zlib.crc32(x.tobytes())) for n, a, x in document_ids(block)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return map_arrow(
        blocks.select("bits", "n_ids", "payload", "doc_ids", "offsets", "start"), digest,
        "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    )


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document; Parquet statistics leave out the other blocks."""
    found = read_blocks(spark, folder).where((F.col("min_doc") <= doc_id) & (F.col("max_doc") >= doc_id))
    out = []
    for row in found.orderBy("start").collect():
        for name, a, b in zip(row.doc_ids, row.offsets, row.offsets[1:]):
            if name == doc_id:
                out.append(unpack(row.payload, row.bits, a, b - a))
    return out
