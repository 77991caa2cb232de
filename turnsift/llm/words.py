"""Word splitting and Arrow column helpers shared by the operators.

Both word classes are cut on UTF-8 bytes: every byte of 0x80 and above belongs to a word, so
``bytes.translate`` and ``bytes.split`` give the same words as a regex over code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and everything outside ASCII."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return text.lower().split()


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as bytes; a null is an empty text."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``function`` for every Arrow batch of ``df``; it may give any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)
