import math
import zlib
from collections import Counter

import numpy as np
import pytest

from turnsift.llm import language_model as lm


def base(rows):
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    tokens = [lm.tokens((t or "").encode()) for _, t in rows]
    counts = Counter(w for i, own in enumerate(tokens) if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(d), held[i], len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 5))
        for i, ((d, _), own) in enumerate(zip(rows, tokens))
    )


def shown(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect())


@pytest.mark.parametrize("head", [lm.HEAD, 3])
def test_base_score(documents, odd_texts, head):
    """With few frequent words nearly all counts come by the join."""
    rows = [*odd_texts, *[(100 + k, f"w{k} common words common {'w' * 80}") for k in range(30)]]
    assert shown(lm.score(documents(rows, clashing=True).repartition(3), rounds=1, head=head)) == base(rows)


def test_without_training_texts(documents):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    rows = lm.score(documents([(d, "a b") for d in held])).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(True, 0, 0, 0.0)] * 2
    assert lm.score(documents([])).count() == 0


def test_probabilities_are_normalised():
    counts = np.array([50, 30, 20, 10])
    table = lm.Model.start(counts, 5).log_table()
    assert np.exp(table).sum(axis=2) == pytest.approx(np.ones((4, 4)), abs=1e-5)


def test_training_beats_frequencies(documents):
    """Words that follow each other in a fixed order: the context tells the next word."""
    cycle = [f"w{k}" for k in range(8)]
    rows = [(d, " ".join(cycle[(d + k) % 8] for k in range(60))) for d in range(400)]
    got = lm.score(documents(rows), classes=12).where("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)  # less than half the surprise
