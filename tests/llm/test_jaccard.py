import random

import numpy as np
import pytest

from turnsift.llm import jaccard as jc

SPACE = dict.fromkeys([32, *range(9, 14)], " ")


def gram_set(text):
    """From the definition, with the shingles themselves."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(SPACE)
    words = [w for w in text.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows):
    sets = [gram_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 10 * min(len(a), len(sets[j])) >= 9 * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def invented(random_, n):
    return " ".join("".join(random_.choice("abcdeéñ") for _ in range(random_.randrange(1, 7))) for _ in range(n))


def edited(random_, words, times):
    words = list(words)
    for _ in range(times):
        words[random_.randrange(len(words))] = f"w{random_.randrange(10**9)}"
    return " ".join(words)


def found(documents, rows, **more):
    return sorted(map(tuple, jc.jaccard_components(documents(rows, **more)).collect()), key=repr)


def test_definition(documents, odd_texts):
    assert found(documents, odd_texts, clashing=True) == brute(odd_texts)
    assert found(documents, []) == []


def test_sizes_at_the_limit(documents):
    """Sets of every small size with one n-gram more, one less, and one replaced."""
    rows, doc = [], 0
    for n in range(1, 45):
        words = [f"a{n}x{i}" for i in range(n + 2)]
        for text in (words, words[1:], [*words, "z"], ["z", *words[1:]], words):
            rows.append((doc, " ".join(text).upper() if doc % 2 else " ".join(text)))
            doc += 1
    random.Random(1).shuffle(rows)
    assert found(documents, rows) == brute(rows)


@pytest.mark.parametrize("short", [32, 4])
def test_a_cloud_of_near_copies(documents, short):
    """Copies at all distances from one text, with blocks so small that the lists are compared block by block."""
    r = random.Random(short)
    base = invented(r, 150).split()
    rows = [(i, edited(r, base, r.randrange(0, 9))) for i in range(120)]
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(300 + i, invented(r, r.randrange(1, 60))) for i in range(40)]
    got = sorted(map(tuple, jc.jaccard_components(documents(rows), short, 16).collect()), key=repr)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 20


def test_linked_sets_share_a_key():
    r = random.Random(5)

    def some(n):
        return np.array([r.getrandbits(64) for _ in range(n)], np.uint64)

    for _ in range(1500):
        n = r.choice([10, 11, 12, 15, 20, 30, 50, 100, 300])
        a = np.unique(some(n))
        most = jc._most_different(n, n)
        gone = r.randrange(most + 1)
        b = np.unique(np.append(np.delete(a, r.sample(range(len(a)), gone)), some(most - gone)))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            assert len(np.intersect1d(jc.candidate_keys(a), jc.candidate_keys(b)))


def test_orders_after_the_first(monkeypatch):
    """With all n-grams in one segment of every order only the prefix filter is left."""
    grams = np.arange(1, 41, dtype=np.uint64)
    keys = jc.candidate_keys(grams)
    monkeypatch.setattr(jc, "ORDERS", 1)
    assert len(keys) and len(np.intersect1d(jc.candidate_keys(grams), jc.candidate_keys(grams[1:])))
