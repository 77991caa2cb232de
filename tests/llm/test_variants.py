import random
import zlib

import numpy as np
import pytest

from turnsift.llm import bloom
from turnsift.llm import variants as vr


def letters(c):
    return "a" <= c <= "z" or "À" <= c <= "ÿ"


def vocabulary(rows):
    counts = {}
    for doc_id, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if letters(c) else " " for c in text).split():
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = vocabulary(rows)
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts), key=repr)


def texts(seed, n=60):
    """Words at one and two edits from some stems, in counts from 1 to 300, and some very long ones."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéñß") for _ in range(r.randrange(6, 11))) for _ in range(8)] + ["ß" * 70, "ab" * 33]
    words = []
    for stem in stems:
        for k in range(14):
            word = list(stem)
            for _ in range(k % 3):
                at = r.randrange(len(word))
                word[at : at + r.randrange(2)] = r.choice(["", "a", "é", "zz"[:1]])
            words += ["".join(word)] * r.choice([2, 5, 6, 30, 300])
    # A form of a form.
    words += ["chainaa"] * 6 + ["chainab"] * 40 + ["chainxb"] * 300
    r.shuffle(words)
    cuts = sorted(r.sample(range(len(words)), n))
    return [(i, " ".join(w.upper() if r.random() < 0.2 else w for w in words[a:b])) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)]))]


def found(df, **more):
    return sorted((tuple(r) for r in vr.variant_groups(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("blocks", [1 << 21, 16])
def test_definition(documents, blocks):
    """With 16 blocks a pass holds one small filter, so there are many passes."""
    rows = texts(3)
    got = found(documents(rows, clashing=True), pass_blocks=blocks)
    assert got == brute(rows)
    assert any(f for _, f, *_ in got) and any(f != root for _, f, root, *_ in got if f)


def test_odd_texts(documents, odd_texts):
    rows = [*odd_texts, (None, "straßen " * 6), (20, "straßem×" * 40), (21, "÷" * 300), (22, "é" * 3000 + " " + ("é" * 2999 + " ") * 30)]
    assert found(documents(rows)) == brute(rows)
    assert found(documents([])) == []


def test_a_filter_split_over_passes():
    plan = vr.filter_plan({6: 1000, 7: 10, 64: 40}, pass_blocks=32)
    assert all(sum(blocks for _, blocks in some.values()) <= 32 for some in plan)
    parts = [name for some in plan for name in some]
    assert len(parts) == len(set(parts)) and {s for s, _ in parts} == {6, 7, 64}
    assert [p for s, p in parts if s == 6] == list(range(8))


def test_bloom_filter_misses_nothing():
    keys = bloom.mix(np.arange(5000, dtype=np.uint64))
    bits = bloom.build(keys, bloom.blocks_for(5000))
    assert bloom.holds(bits, keys).all()
    others = bloom.mix(np.arange(10_000, 60_000, dtype=np.uint64))
    assert bloom.holds(bits, others).mean() < 0.02
