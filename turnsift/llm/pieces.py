"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

All pieces of a model go into one automaton.  Reading a text once, the matches that end at a position, longest first
along the output links, relax the best score there.  Positions that no piece reaches fall back to byte pieces, at a
score below every piece.  Ties keep the longest last piece.

Rules: a space is put before a non-empty text, pieces write spaces as U+2581, and U+2581 itself as well as any other
unknown character becomes bytes.  Decoding therefore gives back every text exactly.

No piece holds a space behind another character, and no piece holds a line feed, so the best path of a text is made of
the best paths between such points; these are kept per worker, up to ``KEPT`` of them.  Long stretches are
encoded but not kept.

Null texts are null when encoded and decoded, empty texts have no pieces.  Rows are handled one by one; all other
columns pass through, and a column called ``ids`` or ``score`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from turnsift.llm.words import map_arrow

KEPT = 400_000
LONGEST_KEPT = 48
SPACE = "▁"
_RUNS = re.compile(r" *[^ ]+| +")


class PieceModel:
    """Pieces with scores, and the paths found so far."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int) -> None:
        import ahocorasick

        lowest = min((score for _, _, score in pieces), default=0.0) - 10
        self.byte_ids = byte_ids
        self.scores = np.zeros(size)
        self.scores[byte_ids] = lowest
        self.fallback = lowest
        self.content = [b""] * size
        for value, number in enumerate(byte_ids):
            self.content[number] = bytes([value])
        self.automaton = ahocorasick.Automaton()
        for number, piece, score in pieces:
            plain = piece.replace(SPACE, " ")
            if re.search(r"[^ ] |\n", plain):
                raise ValueError(f"piece {number} holds a space behind other characters or a line feed")
            self.scores[number] = score
            self.content[number] = plain.encode()
            self.automaton.add_word(plain, (number, len(plain), score))
        self.automaton.make_automaton()
        self.kept: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.line_feed = np.array(byte_ids[10:11], "<i4").tobytes()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        byte_ids = [model.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
        return cls([(i, model.id_to_piece(i), model.get_score(i)) for i in plain], byte_ids, size)

    def path(self, text: str) -> bytes:
        """Ids of the best path as little-endian 32-bit integers."""
        n = len(text)
        lowest = self.fallback
        costs = [lowest] * n if text.isascii() else [lowest * len(c.encode()) for c in text]
        best = [0.0] * (n + 1)
        piece = [-1] * (n + 1)
        came = list(range(-1, n))
        opened = 0
        for end, (number, length, score) in self.automaton.iter(text):
            while opened <= end:
                best[opened + 1] = best[opened] + costs[opened]
                opened += 1
            begin = opened - length
            score += best[begin]
            if score > best[opened]:
                best[opened] = score
                piece[opened] = number
                came[opened] = begin
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[value] for value in reversed(text[at - 1].encode()))
            at = came[at]
        return np.array(ids[::-1], "<i4").tobytes()

    def _part(self, text: str) -> bytes:
        found = self.kept.get(text)
        if found is None:
            found = self.path(text)
            if len(text) <= LONGEST_KEPT:
                self.kept[text] = found
        return found

    def _line(self, line: str) -> list[bytes]:
        """A line behind a line feed, or a whole line that begins with a space."""
        if "  " in line or line[-1:] == " ":
            return [self._part(run) for run in _RUNS.findall(line)]
        first, *words = line.split(" ")
        spaced = self.spaced
        long: dict[str, bytes] = {}
        for word in set(words).difference(spaced):
            (spaced if len(word) <= LONGEST_KEPT else long)[word] = self.path(" " + word)
        coded = [spaced[word] if word in spaced else long[word] for word in words] if long else map(spaced.__getitem__, words)
        return [self._part(first) if first else b"", *coded]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        if len(self.kept) + len(self.spaced) > KEPT:
            self.kept.clear()
            self.spaced.clear()
        first, *lines = (" " + text).split("\n")
        out = self._line(first)
        for line in lines:
            out.append(self.line_feed)
            if line:
                out += self._line(line)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.content.__getitem__, ids.tolist()))[1:].decode()


@cache
def model_at(path: str) -> PieceModel:
    return PieceModel.load(path)


def _with(schema: StructType, **columns) -> StructType:
    kept = [f for f in schema.fields if f.name not in columns]
    out = StructType(kept)
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def encode_pieces(documents: DataFrame, model: str, verify: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``score``, the sum of the scores of the pieces; ``verify`` decodes each text again."""
    rows = documents.withColumn("text", F.col("text").cast("string"))
    rows = rows.drop("ids", "score")
    schema = _with(rows.schema, ids=ArrayType(IntegerType()), score=DoubleType())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = model_at(model)
        texts = batch.column("text").to_pylist()
        codes = [pieces.encode(t or "") for t in texts]
        if verify and any(pieces.decode(c) != (t or "") for c, t in zip(codes, texts)):
            raise ValueError("a text does not decode to itself")
        missing = np.array([t is None for t in texts], bool)
        offsets = np.append(0, np.cumsum([len(c) for c in codes])).astype(np.int32)
        values = np.concatenate([*codes, np.empty(0, "<i4")])
        ids = pa.ListArray.from_arrays(
            pa.array(offsets, mask=np.append(missing, False)), pa.array(values, pa.int32())
        )
        sums = np.array([pieces.scores[c].sum() for c in codes], float)
        columns = [batch.column(f.name) for f in schema.fields[:-2]]
        yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(sums, mask=missing)], schema.names)

    return map_arrow(rows, run, schema)


def _id_arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The ids of each row, without a Python object per id."""
    values = column.values.to_numpy()
    offsets = column.offsets.to_pylist()
    for a, b, valid in zip(offsets, offsets[1:], column.is_valid().to_pylist()):
        yield values[a:b] if valid else None


def decode_pieces(encoded: DataFrame, model: str, column: str = "text") -> DataFrame:
    """Replaces or adds ``column`` with the texts of ``ids``."""
    rows = encoded.drop(column)
    schema = _with(rows.schema, **{column: StringType()})

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = model_at(model)
        texts = [None if ids is None else pieces.decode(ids) for ids in _id_arrays(batch.column("ids"))]
        columns = [batch.column(f.name) for f in schema.fields[:-1]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema.names)

    return map_arrow(rows, run, schema)


def piece_digests(encoded: DataFrame, model: str) -> DataFrame:
    """Per row ``n_pieces``, ``ids_crc32`` of the ids as 32-bit integers, ``score``, and what decoding them gives."""
    rows = encoded.select("doc_id", "text", "ids", "score")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = model_at(model)
        out = []
        for ids, text in zip(_id_arrays(batch.column("ids")), batch.column("text")):
            if ids is None:
                out.append((0, 0, hashlib.sha256().hexdigest(), True))
            else:
                back = pieces.decode(ids)
                own = np.ascontiguousarray(ids, "<i4").tobytes()
                out.append((len(ids), zlib.crc32(own), hashlib.sha256(back.encode()).hexdigest(), back == text.as_py()))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        n, crc, sha, same = (pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), n, crc, batch.column("score"), sha, same],
            ["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256", "round_trip"],
        )

    return map_arrow(rows, run, (
        f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, score double, decoded_sha256 string, round_trip boolean"
    ))
