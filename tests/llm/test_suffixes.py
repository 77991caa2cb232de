import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnsift.llm import suffixes as sx


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + sx.LENGTH] for _, t in texts for i in range(len(t) - sx.LENGTH + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - sx.LENGTH + 1):
            if counts[t[i : i + sx.LENGTH]] > 1:
                gone[i : i + sx.LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, group=sx.GROUP):
    return sorted(map(tuple, sx.repeat_digests(df, group).collect()), key=repr)


def letters(r, n):
    return "".join(r.choice("abcdé ") for _ in range(n))


@pytest.fixture(scope="module")
def woven():
    """Passages of many lengths, shared by many texts with other surroundings each time."""
    r = random.Random(5)
    passages = [letters(r, n) for n in (150, 199, 200, 201, 260, 330, 700)]
    rows = []
    for d in range(150):
        text = ""
        for _ in range(r.randrange(1, 4)):
            text += letters(r, r.randrange(0, 200)) + r.choice(passages)[r.choice([0, 0, 3, 40]) :]
        rows.append((d, text))
    return rows


@pytest.mark.parametrize("group", [sx.GROUP, 30, 1])
def test_every_window(documents, woven, group):
    """Small groups send every core through the recursion."""
    assert found(documents(woven), group) == brute(woven)


def test_odd_input(documents, odd_texts):
    rows = [x for x in odd_texts if x[0] not in (9, 13)]
    rows += [(30, "ab" * 400), (31, "a" * 199), (32, "a" * 200), (33, "é" * 300), (34, odd_texts[9][1][:3000]), (35, odd_texts[9][1][500:2500])]
    assert found(documents(rows, clashing=True)) == brute(rows)
    assert found(documents([])) == []


def test_long_texts_are_taken_in_stretches(documents, monkeypatch):
    r = random.Random(9)
    shared = letters(r, 900)
    text = letters(r, 4000) + shared + letters(r, 4000)
    assert sum(last - first + 1 for _, first, last in sx.anchors(text.encode())) == len(text.encode()) - sx.LENGTH + 1
    whole = list(sx.anchors(text.encode()))
    monkeypatch.setattr(sx, "STRETCH", 500)
    cut = list(sx.anchors(text.encode()))
    assert {(a, w) for a, f, l in whole for w in range(f, l + 1)} == {(a, w) for a, f, l in cut for w in range(f, l + 1)}


def test_equal_windows_have_equal_anchors():
    r = random.Random(2)
    shared = letters(r, 600).encode()
    at = []
    for _ in range(2):
        head = letters(r, 333).encode()
        owner = {w: a for a, f, l in sx.anchors(head + shared) for w in range(f, l + 1)}
        at.append([owner[w] - len(head) for w in range(len(head), len(head) + len(shared) - sx.LENGTH + 1)])
    assert at[0] == at[1]


def test_texts_are_cut(documents):
    r = random.Random(3)
    shared = letters(r, 250)
    rows = [(1, "One é " + shared), (2, shared + " two"), (3, "three")]
    texts = {x.doc_id: x.text for x in sx.cut_repeats(documents(rows)).collect()}
    assert (texts[1], texts[2], texts[3]) == ("One é ", " two", "three") or len(texts[1]) < 7
