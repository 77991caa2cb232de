import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnsift.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = convs.get(conv - conv % 5, [])[:h] + own[h:]
    return out


def brute(rows):
    members = {}
    convs = rebuilt(rows)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, convs_here in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs_here if len(convs[c]) == len(node))
        parents = {n[:-1] for n in members if n}
        out.append((
            min(convs_here), len(node), min(members[node[:-1]]) if node else None, len(convs_here), sum(1 for n in below if len(n) == len(node) + 1),
            sum(1 for n in below if n not in parents), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({c: F.lit(7) for c in ("depth", "k1", "k2", "place", "size", "band", "m1", "start", "leaf", "n")})


def found(spark, rows, **sizes):
    return sorted((tuple(r) for r in pt.conversation_trie(table(spark, rows), **sizes).select(*COLUMNS).collect()), key=repr)


def generated(seed, convs=60, turns=7):
    """Conversations with shared starts, among them copies and starts of others."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(convs * 2), convs):
        for t in range(r.randrange(turns + 1)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "é", "longer text"]) if t else "hello"))
    return rows


@pytest.mark.parametrize("chunk", [20_000, 5])
def test_definition(spark, mode, chunk):
    rows = generated(chunk)
    assert found(spark, rows, chunk=chunk) == brute(rows)


def test_long_conversations_in_bands(spark, mode):
    r = random.Random(2)
    rows = []
    for c in range(0, 40, 2):
        long = r.choice([3, 4, 5, 8, 9, 30])
        rows += [(c, t, "user", "same" if t < 26 else r.choice("xy")) for t in range(long)]
    rows += [(101, t, "user", f"t{t}") for t in range(150)] + [(102, t, "user", f"t{t}") for t in range(150)]
    assert found(spark, rows, width=4) == brute(rows)


def test_odd_rows(spark, mode):
    rows = [
        (0, None, None, None), (0, 0, "user", "b"), (0, 0, "user", "a"), (0, 0, "user", "a"), (1, 0, "user", ""), (2, 1, None, "x" * 100_000),
        (3, 0, "user", "only"), (None, 0, "user", "lost"), (-3, 0, "user", "below"), (6, 0, "user", "no base"), (10**15, 2, "system", "far"), (-6, 1, "user", "z"),
    ]
    assert found(spark, [r for r in rows if (r[0] or 0) >= 0]) == brute([r for r in rows if (r[0] or 0) >= 0])
    assert found(spark, [(None, 0, "user", "lost")]) == []
    assert found(spark, []) == []
    assert len(found(spark, rows)) > 5


def test_double_array():
    r = random.Random(1)
    sequences = [[r.randrange(40) for _ in range(r.randrange(1, 9))] for _ in range(400)]
    ids = np.array([i for s in sequences for i in s])
    sizes = np.array([len(s) for s in sequences])
    starts = np.cumsum(sizes) - sizes
    trie = pt.DoubleArray(ids, starts, sizes)
    slots = trie.walk(ids, starts, sizes)
    nodes = {}
    for s, start in zip(sequences, starts):
        for d in range(len(s)):
            nodes.setdefault(tuple(s[: d + 1]), set()).add(int(slots[start + d]))
    assert all(len(x) == 1 for x in nodes.values()) and len({min(x) for x in nodes.values()}) == len(nodes)
    other = np.array([39, 41, 0])
    walked = trie.walk(other, np.array([0]), np.array([3]))
    assert walked[1] == walked[2] == -1
