import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use themselves.
CLASHING = [
    "n_words", "spans", "items", "text_hash", "windows", "ids", "score", "stratum", "_words", "fingerprint", "key", "name",
    "kept", "count", "found", "held_out", "doc_key", "n", "_row", "first", "root",
]


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs; ``clashing`` adds columns with names that operators use."""

    def make(rows, clashing=False):
        data = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(data, DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in CLASHING})
        return df

    return make


def invented(random_, n, size=40):
    return " ".join("".join(random_.choice("abcdeéñ") for _ in range(random_.randrange(1, 7))) for _ in range(n))


@pytest.fixture
def odd_texts():
    """Null, empty, blank, tiny, repetitive, repeated and very long texts."""
    r = random.Random(7)
    long = invented(r, 40_000)
    same = invented(r, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a " * 700), (6, same), (7, same), (8, same + " more"), (8, same),
        (9, long), (10, "x" * 5000), (11, "▁ ▁\n\n  b  "), (None, same), (12, "Ünï¢ode \x1c \x85 　 text"),
        (13, long[:9000] + " end"), (14, "UNDER THE MIT LICENSE. Under the MIT-license"),
    ]
