import random
import re

import pytest
from pyspark.sql import functions as F

from turnsift.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=13):
    """Compares every window of every item with every place of every text."""
    cut = [(str(i), words(t)) for i, t in items if words(t)]
    out = []
    for d, text in rows:
        own, hit, names = words(text), set(), set()
        for i, w in cut:
            size = min(window, len(w))
            runs = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)}
            for p in range(len(own) - size + 1):
                if tuple(own[p : p + size]) in runs:
                    hit.update(range(p, p + size))
                    names.add(i)
        out.append((d, len(own), len(hit), ",".join(sorted(names))))
    return sorted(out, key=repr)


def found(docs, items, **options):
    rows = dc.judged(dc.contamination(docs, items, **options))
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows.collect()), key=repr
    )


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_against_every_window(spark, documents, block_words):
    r = random.Random(1)
    items = [(k, " ".join(r.choice("abc") for _ in range(r.choice([1, 2, 5, 12, 13, 14, 30])))) for k in range(25)]
    rows = [(d, " ".join(r.choice("abcX,") for _ in range(r.randrange(0, 120)))) for d in range(120)]
    items.append((90, " ".join(r.choice("abc") for _ in range(200))))  # longer than a small block
    rows += [(500 + k, f"zz {t.upper()} yy") for k, t in items] + [(900, items[6][1] + " " + items[6][1])]
    got = found(documents(rows), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words)
    assert got == brute(rows, items)


def test_odd_input(spark, documents, odd_texts):
    items = [(1, None), (2, ""), (3, odd_texts[5][1]), (3, odd_texts[5][1]), (4, "a a a a a a a a a a a a a a")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n_words int")
    got = found(documents(odd_texts, clashing=True), table)
    assert got == brute(odd_texts, items)
    assert found(documents([]), table) == []
    assert {x[2] for x in found(documents(odd_texts), table.limit(0))} == {0}


def test_spans_are_cut_from_the_text(spark, documents):
    item = " ".join(f"w{k}" for k in range(20))
    docs = documents([(1, f"Before. {item.upper()}! After"), (2, "nothing here")])
    rows = dc.contamination(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"), keep_text=True)
    texts = {r.doc_id: r.text for r in dc.cut_spans(rows).collect()}
    assert texts == {1: "Before. ! After", 2: "nothing here"}


def test_limits(spark, documents):
    item = " ".join(f"w{k}" for k in range(13))
    rows = [(1, item + " x" * 247), (2, item + " x" * 248), (3, "x")]
    judged = dc.judged(dc.contamination(documents(rows), spark.createDataFrame([(1, item)], "item_id bigint, text string")))
    assert {r.doc_id: r.contaminated for r in judged.collect()} == {1: True, 2: False, 3: False}
    assert judged.where(F.col("contaminated")).count() == 1


def test_one_automaton_at_a_time(spark, documents):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(5)], "item_id bigint, text string")
    rows = documents([(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(6)])
    made = dc.contamination(rows, items, block_words=30)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r["items"]) for r in made.collect()) == [(k, [str(k)] if k < 5 else []) for k in range(6)]
