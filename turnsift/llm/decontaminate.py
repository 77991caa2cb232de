"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton.  Reading a document word by word, the automaton
holds the longest run of words ending here that occurs in some item.  Where that run reaches
the window length, every word of it lies in an item window.

* Items shorter than the window count only as a whole.
* The items come to the driver in blocks of ``block_words`` words.  Each block is a broadcast of bounded size and a
  narrow pass over the documents that adds to what the passes before it found; nothing is shuffled.  All passes but the
  last are written and their broadcasts released, so memory does not grow with the number of blocks.
* Words that no pair of neighbouring item words can cover are skipped before the walk, which changes no match.

Nulls and empty texts have no words and are never contaminated.  Rows that share a ``doc_id`` are judged
one by one, repeated items count once by ``item_id``, an empty item table hits nothing, other columns of
either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm.words import ALNUM, alnum_words, byte_texts, map_arrow
from turnsift.session import cut_lineage

PAIR_BITS = 22


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers; state 0 is the empty run."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    following: list[dict[int, int]] = field(default_factory=lambda: [{}])
    longest: list[int] = field(default_factory=lambda: [0])
    suffix: list[int] = field(default_factory=lambda: [-1])
    window_items: dict[int, set[str]] = field(default_factory=dict)
    whole_items: dict[int, set[str]] = field(default_factory=dict)

    def _state(self, length: int, following: dict[int, int], suffix: int) -> int:
        self.longest.append(length)
        self.following.append(following)
        self.suffix.append(suffix)
        return len(self.longest) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The runs of ``target`` that fit behind ``state``, as a state of their own."""
        copy = self._state(self.longest[state] + 1, dict(self.following[target]), self.suffix[target])
        self.suffix[target] = copy
        while state >= 0 and self.following[state].get(word) == target:
            self.following[state][word] = copy
            state = self.suffix[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.following[last].get(word)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._state(self.longest[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.following[state]:
            self.following[state][word] = new
            state = self.suffix[state]
        if state >= 0:
            target = self.following[state][word]
            fits = self.longest[target] == self.longest[state] + 1
            self.suffix[new] = target if fits else self._split(state, word, target)
        return new

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a run that ends in ``state``."""
        while self.longest[self.suffix[state]] >= self.window:
            state = self.suffix[state]
        return state

    def build(self, items: list[tuple[str, list[bytes]]]) -> Automaton:
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        for name, codes in coded:
            state = 0
            for at, code in enumerate(codes):
                state = self.following[state][code]
                if at + 1 >= self.window:
                    self.window_items.setdefault(self._window_state(state), set()).add(name)
            if len(codes) < self.window:
                self.whole_items.setdefault(state, set()).add(name)
        self._prepare(coded)
        return self

    def _prepare(self, coded: list[tuple[str, list[int]]]) -> None:
        lengths = {min(len(codes), self.window) for _, codes in coded}
        self.least_pairs = min((n for n in lengths if n > 1), default=1) - 1
        self.single = np.zeros(len(self.vocabulary) + 1, bool)
        self.single[[codes[0] for _, codes in coded if len(codes) == 1]] = True
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, codes in coded:
            run = np.array(codes, np.int64)
            self.pairs[_pair(run[:-1], run[1:])] = True
        #: The nearest state, itself included, that ends a whole short item.
        self.ends: list[int] = [0] * len(self.longest)
        for state in sorted(range(1, len(self.longest)), key=self.longest.__getitem__):
            self.ends[state] = state if state in self.whole_items else self.ends[self.suffix[state]]

    def active(self, codes: np.ndarray) -> np.ndarray:
        """Where a word may lie in a match: runs of enough neighbouring pairs that items know."""
        found = np.zeros(len(codes), bool)
        known = (codes[:-1] >= 0) & (codes[1:] >= 0)
        known[known] = self.pairs[_pair(codes[:-1][known], codes[1:][known])]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= self.least_pairs]:
            found[a : b + 1] = True
        return found | self.single[codes]

    def walk(self, codes: list[int], spans: list[list[int]], items: set[str], at: int) -> None:
        """Adds the hit spans and items of one active stretch that begins at word ``at``."""
        state = length = 0
        for place, code in enumerate(codes, at):
            while state and code not in self.following[state]:
                state = self.suffix[state]
                length = self.longest[state]
            state = self.following[state].get(code, 0) if code >= 0 else 0
            length = length + 1 if state else 0
            if length >= self.window:
                items |= self.window_items[self._window_state(state)]
                _cover(spans, place - length + 1, place)
            whole = state if length == self.longest[state] else self.suffix[state] if state else 0
            whole = self.ends[whole]
            if whole:
                _cover(spans, place - self.longest[whole] + 1, place)
            while whole:
                items |= self.whole_items[whole]
                whole = self.ends[self.suffix[whole]]

    def matches(self, codes: np.ndarray) -> tuple[list[list[int]], set[str]]:
        """Hit spans (first and last word) in ascending order, and the items with occurring windows."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if len(codes):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], self.active(codes).view(np.int8), [0]))))
            for a, b in edge.reshape(-1, 2).tolist():
                self.walk(codes[a:b].tolist(), spans, items, a)
        return spans, items


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << PAIR_BITS) - 1)


def _cover(spans: list[list[int]], first: int, last: int) -> None:
    """Adds a span that ends no earlier than those before it."""
    while spans and spans[-1][1] >= first - 1:
        first = min(first, spans.pop()[0])
    spans.append([first, last])


def _joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for first, last in sorted([*a, *b], key=lambda s: (s[1], s[0])):
        _cover(spans, first, last)
    return spans


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of about ``block_words`` words.

    A longer item is cut into stretches that share all but one word of a window, so each of its windows lies in one.
    """
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        words = alnum_words(row.text.encode())
        for at in range(0, max(len(words) - window + 1, min(len(words), 1)), block_words):
            part = words[at : at + block_words + window - 1]
            block.append((row.item_id or "", part))
            size += len(part)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def contamination(
    documents: DataFrame, items: DataFrame, window: int = 13, block_words: int = 500_000, keep_text: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The words of each document that item windows hit.

    Gives ``doc_id``, the columns ``carry``, ``text`` if asked for, ``n_words``, ``spans`` (pairs of first and last hit word, disjoint and
    ascending) and ``items`` (the ids of items with an occurring window, sorted as strings).
    """
    found = documents.select(
        "doc_id", *carry, F.col("text").cast("string").alias("text"), F.lit(None).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    blocks = item_blocks(items, window, block_words)
    block, after = next(blocks, []), next(blocks, None)
    while block is not None:
        shared = documents.sparkSession.sparkContext.broadcast(Automaton(window).build(block))
        found = _scan(found, shared, keep_text or after is not None)
        if after is not None:
            # Written, so that no task holds the automata of two blocks.
            found = cut_lineage(found)
            shared.destroy()
        block, after = after, next(blocks, None)
    return found


def _scan(found: DataFrame, shared: Broadcast, keep_text: bool) -> DataFrame:
    after = found if keep_text else found.drop("text")
    columns = after.columns

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        number = known.vocabulary.get
        sizes, spans, items = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        for k, text in enumerate(byte_texts(batch.column("text"))):
            codes = np.array([number(w, -1) for w in alnum_words(text)], np.int64)
            hit, names = known.matches(codes)
            sizes.append(len(codes))
            spans[k] = _joined(spans[k], hit) if spans[k] else hit
            items[k] = sorted(names.union(items[k] or ()))
        made = {"n_words": sizes, "spans": spans, "items": items}
        yield pa.RecordBatch.from_pydict({
            c: pa.array(made[c], batch.schema.field(c).type) if c in made else batch.column(c) for c in columns
        })

    return map_arrow(found, scan, after.schema)


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0] + 1)


def judged(found: DataFrame, max_coverage: tuple[int, int] = (1, 20)) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: hit words reach the share ``max_coverage`` (a fraction) of all words."""
    part, whole = max_coverage
    return found.withColumn("n_hit", hit_words()).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (whole * F.col("n_hit") >= part * F.col("n_words"))
    )


def cut_spans(found: DataFrame, min_span: int = 13) -> DataFrame:
    """``found`` whose ``text`` has lost every hit span of ``min_span`` words or more; other texts stay as they are."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            long = [s for s in spans or [] if s[1] - s[0] + 1 >= min_span]
            if long:
                texts[k] = _without(texts[k].encode(), long).decode()
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    return map_arrow(found, cut, found.schema)


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    plain = np.frombuffer(text.translate(ALNUM), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : starts[first]])
        at = ends[last]
    return b"".join([*kept, text[at:]])
