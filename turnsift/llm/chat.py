"""Chat formatting by columnar byte assembly.

A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Inside roles and texts every ``<`` that is
followed by backslashes and a bar gets one backslash more, so control strings never appear in content and reading takes
the backslash away again.

A batch of turns is laid out at once: the lengths of all segments, their cumulative offsets, then one gather that
copies headers and contents into a single preallocated buffer, which becomes the Arrow column as it is.

Conversations are written in parts of bounded size (``part_bytes``): each part holds consecutive turns of one
conversation and the byte spans of the texts that count for the loss.  Turns are range-partitioned by conversation and
turn, so a conversation of any length is spread over tasks and never has to fit into memory; the numbers of its parts
ascend.  Only a hash over a whole conversation has to read its parts one after the other, part by part.

Null roles and texts are empty, turns without a conversation form one of their own.  Turns are ordered by ``turn`` (nulls first), equal turns by role and text; repeated rows
stay.  An empty table gives an empty output, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed parts of a turn; content never contains them because "<|" is escaped there.
OPEN, MIDDLE, CLOSE = b"<|turn|>", b"<|text|>", b"<|end|>\n"
LOSS_ROLE = "assistant"
PART_BYTES = 1 << 20
PARTS = "conv_id bigint, part bigint, formatted string, n_turns bigint, loss array<struct<start:int,length:int>>"
_TURN = re.compile(re.escape(OPEN) + b"(.*?)" + re.escape(MIDDLE) + b"(.*?)" + re.escape(CLOSE), re.S)
_ESCAPED = re.compile(rb"<(\\*)\\\|")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\1\\|")


def unescape(content: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", content)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, where each turn begins (one more than turns) and where its text begins."""
    fixed = np.frombuffer(OPEN + MIDDLE + CLOSE, np.uint8)
    role_bytes, role_at = _buffers(roles)
    text_bytes, text_at = _buffers(texts)
    source = np.concatenate((fixed, role_bytes, text_bytes))
    n = len(roles)
    # Five segments per turn: where each comes from in ``source`` and how long it is.
    begin = np.empty((n, 5), np.int64)
    length = np.empty((n, 5), np.int64)
    begin[:, 0], length[:, 0] = 0, len(OPEN)
    begin[:, 1], length[:, 1] = role_at[:-1] + len(fixed), np.diff(role_at)
    begin[:, 2], length[:, 2] = len(OPEN), len(MIDDLE)
    begin[:, 3], length[:, 3] = text_at[:-1] + len(fixed) + len(role_bytes), np.diff(text_at)
    begin[:, 4], length[:, 4] = len(OPEN) + len(MIDDLE), len(CLOSE)
    ends = np.cumsum(length.ravel())
    starts = ends - length.ravel()
    index = np.arange(ends[-1] if n else 0) + np.repeat(begin.ravel() - starts, length.ravel())
    turn_at = np.append(starts[::5], ends[-1:] if n else [0])
    return source[index], turn_at, starts[3::5]


def _parts(batch: pa.RecordBatch, numbers: dict[int | None, int], part_bytes: int, loss_role: str) -> pa.RecordBatch:
    roles = pc.fill_null(batch.column("role").cast(pa.large_string()), "")
    texts = escape(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    data, turn_at, text_at = assemble(escape(roles), texts)
    names, shard = batch.column("conv_id"), batch.column("shard")[0].as_py()
    conv, missing = pc.fill_null(names, 0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)
    n = len(conv)
    new = np.append(True, (conv[1:] != conv[:-1]) | (missing[1:] != missing[:-1]))
    group = np.cumsum(new) - 1
    chunk = (turn_at[:-1] - turn_at[:-1][new][group]) // part_bytes
    first = np.flatnonzero(new | np.append(True, chunk[1:] != chunk[:-1]))
    after = np.append(first[1:], n)
    parts = []
    for c in names.take(pa.array(first)).to_pylist():
        at = numbers.get(c, shard << 32)
        numbers.clear()  # sorted rows: only the last conversation can go on in the next batch
        numbers[c] = at + 1
        parts.append(at)
    counts = np.array([r == loss_role for r in roles.to_pylist()], bool)
    scored = np.flatnonzero(counts)
    part_of = np.searchsorted(first, scored, "right") - 1
    base = turn_at[first]
    spans = pa.StructArray.from_arrays(
        [
            pa.array(text_at[scored] - base[part_of], pa.int32()),
            pa.array(turn_at[scored + 1] - len(CLOSE) - text_at[scored], pa.int32()),
        ],
        ["start", "length"],
    )
    span_at = np.append(0, np.cumsum(np.bincount(part_of, minlength=len(first))))
    offsets = np.append(base, turn_at[n])
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(first)), pa.array(parts, pa.int64()),
            pa.Array.from_buffers(pa.large_utf8(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.utf8()),
            pa.array(after - first, pa.int64()), pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
        ],
        ["conv_id", "part", "formatted", "n_turns", "loss"],
    )


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted conversations in parts; ``loss`` gives byte spans of the texts by ``loss_role`` as they stand there."""
    rows = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "role", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[int | None, int] = {}
        for batch in batches:
            if batch.num_rows:
                yield _parts(batch, numbers, part_bytes, loss_role)

    return rows.mapInArrow(run, PARTS)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn of a part."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def conversation_digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read from its parts in order: turns, hash of turns, loss text, formatted length."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        state: list = []  # of the conversation being read

        def ended(out: list[tuple]) -> None:
            if state:
                conv, n, turns, chars, loss, long = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), long))

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], arrow)

        arrow = pa.schema([
            (n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names
        ])
        for batch in batches:
            out: list[tuple] = []
            for part in batch.select(["conv_id", "formatted", "loss"]).to_pylist():
                if not state or state[0] != part["conv_id"]:
                    ended(out)
                    state[:] = [part["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = part["formatted"].encode()
                for role, text in read_turns(data):
                    state[1] += 1
                    state[2].update(b"%b\n%b\n" % (role, text))
                for span in part["loss"]:
                    text = unescape(data[span["start"] : span["start"] + span["length"]])
                    state[3] += len(text.decode())
                    state[4].update(text)
                state[5] += len(part["formatted"])
            if out:
                yield made(out)
        out = []
        ended(out)
        if out:
            yield made(out)

    return rows.mapInArrow(run, schema)
