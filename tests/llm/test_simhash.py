import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnsift.llm import simhash as sh
from turnsift.llm.components import connected_components


def fingerprint(text):
    """Bit by bit, from the definition."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    own = sorted({p for _, p in prints})
    top = classes(own, [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if bin(a ^ b).count("1") <= 2])
    first = {}
    for d, p in prints:
        if d is not None:
            first[top[p]] = min(d, first.get(top[p], d))
    return sorted(((d, f"{p:016x}", first.get(top[p])) for d, p in prints), key=repr)


def test_definition(documents, odd_texts):
    rows = [x for x in odd_texts if x[0] != 9]
    got = sh.near_duplicates(documents(rows, clashing=True)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert sh.near_duplicates(documents([])).count() == 0


def test_spark_agrees_on_the_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("a b é".encode(), 42)


@pytest.mark.parametrize("spread", [12, 16, 40])
def test_all_links_are_found(spark, spread):
    """Clusters of fingerprints, some so dense that their lists are long."""
    r = np.random.default_rng(spread)
    base = r.integers(0, 1 << 63, 3)
    prints = np.unique(np.concatenate([b ^ r.integers(0, 1 << spread, 700) for b in base] + [base ^ (r.integers(0, 1 << 9, 3) << 50)]))
    own = prints.tolist()
    linked = [(own[i], own[j]) for i in range(len(own)) for j in range(i + 1, len(own)) if (own[i] ^ own[j]).bit_count() <= 2]
    found = sh.links(spark.createDataFrame([(p,) for p in own], "fingerprint bigint"))
    pairs = {tuple(sorted(x)) for x in found.collect()}
    assert pairs <= set(linked)
    assert classes(own, pairs) == classes(own, linked)
    roots = {x.node: x.root for x in connected_components(found).collect()}
    assert {n: roots.get(n, n) for n in own} == classes(own, linked)


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    linked = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000 - k, 5001 - k) for k in range(100)]
    linked += [(r.randrange(9000, 9400), r.randrange(9000, 9400)) for _ in range(150)]
    nodes = {x for pair in linked for x in pair}
    r.shuffle(linked)
    got = connected_components(spark.createDataFrame(linked, "a bigint, b bigint")).collect()
    want = classes(nodes, linked)
    lone = {n for n in nodes if n not in {x for a, b in linked if a != b for x in (a, b)}}
    assert {x.node: x.root for x in got} == {n: t for n, t in want.items() if n not in lone}


def test_one_row_of_each_group_stays(documents):
    rows = [(3, "same text of many words here"), (2, "same text of many words here"), (2, "same text of many words here"), (7, "other")]
    rows += [(None, "same text of many words here"), (None, "all alone"), (None, "alone too"), (None, "alone too"), (9, "other thing")]
    kept = sh.one_per_group(documents(rows, clashing=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(2, "same text of many words here"), (7, "other"), (9, "other thing"), (None, "all alone"), (None, "alone too")], key=repr
    )
