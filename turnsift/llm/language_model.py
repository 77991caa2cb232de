"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words of a text and one end token.  The model predicts the class of a token from the two tokens before it:
the ``CLASSES - 1`` most frequent training words are classes of their own, all other words share class 0 and are told apart
by their smoothed frequency.  A context is the sum of two matrix-transformed word vectors; its product with the output
vectors plus a bias gives the class scores.

* **Counts.** Every training token is counted: combined per task, then by word.
* **Training.** Each task counts the trigrams of its own training texts, trains a copy of the model on them in numpy with
  noise-contrastive estimation (``EPOCHS`` passes in minibatches of weighted trigrams, noise drawn from the class frequencies), and hands on its
  parameters; their mean, weighted by tokens, starts the next of ``ROUNDS`` rounds.  All training texts take part.
* **Scores.** Batched matrix products over all pairs of context classes give one table of normalised log probabilities per worker, in
  which tokens are looked up.
* **Rare words.** Counts of the frequent words (at most ``HEAD`` of ``LONGEST`` bytes or less) are broadcast.  All others, of which
  none is frequent, meet their counts by a join on the word: each task sends a word once with the documents that hold it, and the
  sums come back by document.

Null texts are empty: one end token.  Without training texts all counts are zero and every score is 0.  A null ``doc_id``
belongs to the training texts.  Rows that share a ``doc_id`` are scored one by one.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm.words import byte_texts, map_arrow, space_words
from turnsift.session import cut_lineage

#: Words hold no line feed, so it stands for the end of a text.
END = b"\n"
FOLDS, HELD_OUT = 7, 2
CLASSES = 256
DIMENSIONS = 16
HEAD = 100_000
LONGEST = 64
FLUSH = 500_000
#: Sums that a task holds back; few, so that what it sends follows its input and not the number of documents.
HELD_SUMS = 1 << 15
EPOCHS, ROUNDS, BATCH, NOISE, RATE, SLOPE = 3, 2, 4096, 64, 0.1, 1e-4


def tokens(text: bytes) -> list[bytes]:
    words = space_words(text)
    words.append(END)
    return words


def with_fold(documents: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return documents.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n, n_all``: how often each word stands in the training texts, and in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            words = list(train.keys() | held.keys())
            n = np.fromiter(map(train.__getitem__, words), np.int64, len(words))
            more = np.fromiter(map(held.__getitem__, words), np.int64, len(words))
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(n), pa.array(n + more)], ["word", "n", "n_all"]
            )

        for batch in batches:
            for text, out in zip(byte_texts(batch.column("text")), batch.column("held_out").to_pylist()):
                (held if out else train).update(tokens(text))
                if len(train) + len(held) > FLUSH:
                    yield made()
                    train.clear()
                    held.clear()
        yield made()

    partial = rows.select("text", "held_out").mapInArrow(run, "word binary, n bigint, n_all bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


@dataclass
class Vocabulary:
    """Counts of the frequent words, the classes among them, and the totals of the training texts."""

    counts: dict[bytes, int]
    classes: dict[bytes, int]
    total: int
    distinct: int

    @property
    def class_counts(self) -> np.ndarray:
        own = np.zeros(len(self.classes) + 1, np.int64)
        for word, number in self.classes.items():
            own[number] = self.counts[word]
        own[0] = self.total - own.sum()
        return own

    @property
    def rare_total(self) -> int:
        """Denominator of a word's smoothed frequency within class 0."""
        return int(self.class_counts[0]) + self.distinct - len(self.classes) + 1


def vocabulary(counts: DataFrame, classes: int = CLASSES, head: int = HEAD) -> Vocabulary:
    seen = F.count_if(F.col("n") > 0)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), seen).first()
    # Counts fall into a few hundred steps of a sixteenth of a power of two; whole steps are frequent or not.
    step = F.floor(F.log2("n_all") * 16).cast("int")
    short = counts.where(F.octet_length("word") <= LONGEST)
    kept, least = 0, 1 << 20
    for number, words in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        if kept + words > head:
            break
        kept, least = kept + words, number
    frequent = {bytes(w): n for w, n in short.where(step >= least).select("word", "n").collect()}
    best = sorted((w for w, n in frequent.items() if n), key=lambda w: (-frequent[w], w))[: classes - 1]
    return Vocabulary(frequent, {w: k for k, w in enumerate(best, 1)}, int(total), int(distinct))


@dataclass
class Model:
    """Word vectors, context matrices, output vectors and biases."""

    vectors: np.ndarray
    matrices: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    @classmethod
    def start(cls, class_counts: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        random = np.random.default_rng(0)
        k = len(class_counts)
        matrices = np.stack([np.eye(dimensions)] * 2) * 0.5
        shares = (class_counts + 1) / (class_counts.sum() + k)
        return cls(
            random.normal(0, 0.1, (k, dimensions)), matrices, random.normal(0, 0.1, (k, dimensions)), np.log(shares)
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.matrices, self.outputs, self.biases]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, flat: np.ndarray) -> Model:
        ends = np.cumsum([p.size for p in self.parts])
        return Model(*[x.reshape(p.shape).copy() for x, p in zip(np.split(flat, ends[:-1]), self.parts)])

    def contexts(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.vectors[far] @ self.matrices[0] + self.vectors[near] @ self.matrices[1]

    def log_table(self) -> np.ndarray:
        """Natural log probabilities of all classes after all pairs of classes."""
        k = len(self.biases)
        table = np.empty((k, k, k), np.float32)
        near = np.arange(k)
        for far in range(k):
            scores = self.contexts(np.full(k, far), near) @ self.outputs.T + self.biases
            scores -= scores.max(axis=1, keepdims=True)
            table[far] = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return table


def _scatter(number: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    return np.stack([np.bincount(number, column, k) for column in values.T], axis=1)


def train(model: Model, grams: np.ndarray, weights: np.ndarray, shares: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Noise-contrastive estimation over weighted trigrams (packed class numbers), with Adagrad steps."""
    k = len(model.biases)
    random = np.random.default_rng(1)
    model = model.filled(model.flat())
    slopes = [np.full(p.shape, SLOPE) for p in model.parts]
    noise_log = np.log(NOISE * shares)
    for _ in range(epochs):
        order = random.permutation(len(grams))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            far, near, word = grams[pick] // (k * k), grams[pick] // k % k, grams[pick] % k
            weight = weights[pick] / weights[pick].sum()
            noise = random.choice(k, NOISE, p=shares)
            context = model.contexts(far, near)
            right = (context * model.outputs[word]).sum(axis=1) + model.biases[word] - noise_log[word]
            wrong = context @ model.outputs[noise].T + model.biases[noise] - noise_log[noise]
            g_right = -weight / (1 + np.exp(np.clip(right, -30, 30)))
            g_wrong = weight[:, None] / (1 + np.exp(-np.clip(wrong, -30, 30)))
            g_context = g_right[:, None] * model.outputs[word] + g_wrong @ model.outputs[noise]
            g_outputs = _scatter(word, g_right[:, None] * context, k)
            g_biases = np.bincount(word, g_right, k)
            np.add.at(g_outputs, noise, g_wrong.T @ context)
            np.add.at(g_biases, noise, g_wrong.sum(axis=0))
            g_matrices = np.stack([model.vectors[far].T @ g_context, model.vectors[near].T @ g_context])
            g_vectors = _scatter(far, g_context @ model.matrices[0].T, k)
            g_vectors += _scatter(near, g_context @ model.matrices[1].T, k)
            for part, slope, g in zip(model.parts, slopes, (g_vectors, g_matrices, g_outputs, g_biases)):
                slope += g * g
                part -= RATE * g / np.sqrt(slope)
    return model


def _class_grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """Packed trigrams of one text's classes; what stands before a text is the end of another."""
    padded = np.concatenate((numbers[-1:], numbers[-1:], numbers))
    return (padded[:-2] * k + padded[1:-1]) * k + padded[2:]


def _one_round(rows: DataFrame, words: Broadcast, start: Model) -> Model:
    """The mean of the models that the tasks train from ``start`` on their own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = words.value
        number = known.classes.get
        k = len(start.biases)
        counts = known.class_counts
        shares = (counts + 1) / (counts + 1).sum()
        model, seen = start, 0
        grams, weights = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merge() -> None:
            nonlocal grams, weights, waiting, size
            merged, where = np.unique(np.concatenate([grams, *waiting]), return_inverse=True)
            ones = np.ones(sum(map(len, waiting)), np.int64)
            weights = np.bincount(where, np.concatenate([weights, ones]), len(merged))
            grams, waiting, size = merged, [], 0

        for batch in batches:
            for text in byte_texts(batch.column("text")):
                numbers = np.array([number(w, 0) for w in tokens(text)], np.int64)
                waiting.append(_class_grams(numbers, k))
                size += len(numbers)
                seen += len(numbers)
                if size > 2_000_000:
                    merge()
                    if len(grams) > 4_000_000:
                        model = train(model, grams, weights, shares)
                        grams, weights = np.empty(0, np.int64), np.empty(0, np.int64)
        if seen:
            merge()
            if len(grams):
                model = train(model, grams, weights, shares)
            flat = model.flat() * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, float(seen)))], ["place", "value"]
            )

    sums = rows.where("not held_out").select("text").mapInArrow(run, "place bigint, value double")
    summed = dict(sums.groupBy("place").agg(F.sum("value")).collect())  # as many rows as the model has parameters
    if not summed:
        return start
    size = len(start.flat())
    return start.filled(np.array([summed[i] for i in range(size)]) / summed[size])


def trained(rows: DataFrame, words: Broadcast, rounds: int = ROUNDS) -> Model:
    model = Model.start(words.value.class_counts)
    for _ in range(rounds):
        model = _one_round(rows, words, model)
    return model


def _rare_words(rows: DataFrame, words: Broadcast) -> DataFrame:
    """Words that are not frequent, each once per task and buffer with the ``doc_key`` and count of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = words.value.counts
        places: dict[bytes, int] = {}
        pairs: list[np.ndarray] = []
        keys: list[int] = []
        size = 0

        def made() -> pa.RecordBatch:
            packed, n = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]), return_counts=True)
            word, document = packed >> 32, packed & 0xFFFFFFFF
            ends = np.append(0, np.cumsum(np.bincount(word, minlength=len(places))))
            held = np.array(keys, "<i8")[document]
            columns = [
                pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
                for x in (held, n.astype("<u4"))
            ]
            return pa.RecordBatch.from_arrays([pa.array(list(places), pa.binary()), *columns], ["word", "keys", "counts"])

        for batch in batches:
            for key, text in zip(batch.column("doc_key").to_pylist(), byte_texts(batch.column("text"))):
                rare = [w for w in tokens(text) if w not in frequent]
                if rare:
                    found = np.array([places.setdefault(w, len(places)) for w in rare], np.int64)
                    pairs.append((found << 32) | len(keys))
                    keys.append(key)
                    size += len(rare)
                if size > FLUSH:
                    yield made()
                    places.clear()
                    pairs.clear()
                    keys.clear()
                    size = 0
        yield made()

    return rows.select("doc_key", "text").mapInArrow(run, "word binary, keys binary, counts binary")


def _rare_sums(rows: DataFrame, counts: DataFrame, words: Broadcast) -> DataFrame:
    """``doc_key, rare_log, rare_known``: per document the sum of log10(c + 1) over its rare tokens, and those with c > 0."""
    found = _rare_words(rows, words).join(counts.select("word", "n"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            keys, logs, known = (np.concatenate(x) for x in zip(*parts))
            own, where = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(own), pa.array(np.bincount(where, logs, len(own))),
                    pa.array(np.bincount(where, known, len(own)).astype(np.int64)),
                ],
                ["doc_key", "rare_log", "rare_known"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8")
            held = batch.column("counts").to_pylist()
            times = np.frombuffer(b"".join(held), "<u4")
            n = np.repeat(batch.column("n").to_numpy(), [len(x) // 4 for x in held])
            parts.append((keys, times * np.log10(n + 1.0), times * (n > 0)))
            size += len(keys)
            if size > HELD_SUMS:
                yield made()
                parts.clear()
                size = 0
        if parts:
            yield made()

    sums = found.select("keys", "counts", "n").mapInArrow(run, "doc_key bigint, rare_log double, rare_known bigint")
    return sums.groupBy("doc_key").agg(F.sum("rare_log").alias("rare_log"), F.sum("rare_known").alias("rare_known"))


def _frequent_sums(rows: DataFrame, words: Broadcast, model: Broadcast) -> DataFrame:
    """Per row its tokens, and what the model and the frequent words add to the scores."""
    tables: list[np.ndarray] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = words.value
        if not tables:
            tables.append(model.value.log_table().ravel())
        k = len(known.classes) + 1
        number, count = known.classes.get, known.counts.get
        out = []
        for text in byte_texts(batch.column("text")):
            own = tokens(text)
            classes = np.array([number(w, 0) for w in own], np.int64)
            seen = np.array([count(w, -1) for w in own], np.int64)
            logs = np.log10(np.maximum(seen, 0) + 1.0)
            out.append((
                len(own), int((seen > 0).sum()), float(logs.sum()),
                float(tables[0][_class_grams(classes, k)].sum(dtype=np.float64)) / np.log(10),
                int((classes == 0).sum()), float(logs[classes == 0].sum()),
            ))
        names = ["n_tokens", "known", "log_all", "class_log", "n_rare", "log_rare"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds]
        kept = [batch.column(c) for c in ("doc_id", "doc_key", "held_out")]
        yield pa.RecordBatch.from_arrays([*kept, *columns], ["doc_id", "doc_key", "held_out", *names])

    rows = rows.select("doc_id", "doc_key", "held_out", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, (
        f"doc_id {kind}, doc_key bigint, held_out boolean, n_tokens bigint, known bigint, log_all double, class_log double, "
        "n_rare bigint, log_rare double"
    ))


def _keyed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with ``doc_key``: the ``doc_id`` if it tells rows apart, else a hash of the row."""
    ids = rows.groupBy("doc_id").count()
    repeated = not ids.where("count > 1 or doc_id is null").isEmpty()
    key = F.xxhash64("doc_id", "text") if repeated else F.col("doc_id").cast("bigint")
    return rows.withColumn("doc_key", key), repeated


def score(
    documents: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD,
    inspect: Callable[[Vocabulary, Model], None] | None = None,
) -> DataFrame:
    """Per row ``held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities of the text)."""
    spark = documents.sparkSession
    rows, repeated = _keyed(with_fold(documents))
    counts = cut_lineage(word_counts(rows))
    known = vocabulary(counts, classes, head)
    words = spark.sparkContext.broadcast(known)
    model = trained(rows, words, rounds)
    if inspect:
        inspect(known, model)
    own = _frequent_sums(rows, words, spark.sparkContext.broadcast(model))
    rare = _rare_sums(rows, counts, words)
    if repeated:
        times = rows.groupBy("doc_key").agg(F.count("*").alias("times"))
        rare = rare.join(times, "doc_key").select(
            "doc_key", (F.col("rare_log") / F.col("times")).alias("rare_log"),
            F.expr("rare_known div times").alias("rare_known"),
        )
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    base_total, rare_total = float(np.log10(known.total + known.distinct + 1)), float(np.log10(known.rare_total))
    return own.join(rare, "doc_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + rare_known).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("log_all") + rare_log - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("class_log") + F.col("log_rare") + rare_log - F.col("n_rare") * rare_total).alias("score"),
    )
