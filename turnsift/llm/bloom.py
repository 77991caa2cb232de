"""Blocked Bloom filters over 64-bit hashes: a key sets and tests four bits of one 64-bit block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB, whatever the number of keys; a fuller filter lets more through.
BLOCKS = 1 << 20
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one, so that sums and products of hashes can be used as hashes again."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def blocks_for(keys: int, bits_per_key: int = 16) -> int:
    """A power of two, so that filters of one size can be merged by ``or``."""
    return 1 << max(4, (max(1, keys) * bits_per_key // 64 - 1).bit_length())


def _place(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit mask of mixed keys: the block from the high bits, the four bits from the low ones."""
    one, six = np.uint64(1), np.uint64(63)
    mask = one << (keys & six)
    for shift in (6, 12, 18):
        mask |= one << ((keys >> np.uint64(shift)) & six)
    return ((keys >> np.uint64(24)) & np.uint64(blocks - 1)).astype(np.int64), mask


def build(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The filter of mixed ``keys``."""
    bits = np.zeros(blocks, np.uint64)
    at, mask = _place(keys, blocks)
    np.bitwise_or.at(bits, at, mask)
    return bits


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which mixed ``keys`` may be in the filter; none that is in it is missed."""
    at, mask = _place(keys, len(bits))
    return bits[at] & mask == mask


def gathered(rows: DataFrame, *columns: str) -> np.ndarray:
    """A filter of ``BLOCKS`` blocks over the ``keys_of`` all rows; the driver gets one row per block at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BLOCKS, np.uint64)
        for batch in batches:
            own |= build(keys_of(*[batch.column(c).to_numpy() for c in columns]), BLOCKS)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["block", "bits"])

    parts = rows.select(*columns).mapInArrow(bits, "block bigint, bits bigint")
    packed = parts.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(BLOCKS, np.uint64)
    whole[packed["block"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    return whole


def keys_of(*columns: np.ndarray) -> np.ndarray:
    """Mixed keys of one or several columns of 64-bit values."""
    keys = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        keys = mix(keys + column.astype(np.int64).view(np.uint64))
    return keys
