"""The whole pipeline on planted cases, against a plain statement of every stage."""

import random
import re
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnsift.llm import pieces as sp
from turnsift.session import fresh_folder

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(11)
    passage, item = sentence(r, 70), sentence(r, 30)
    texts = {k: sentence(r, r.randrange(30, 200)) for k in range(60)}
    texts |= {100: texts[1], 101: texts[1], 102: texts[2] + "!", 103: texts[3].upper()}  # copies, exact and near
    texts |= {110 + k: f"{sentence(r, 40)} {passage} {sentence(r, 40)}" for k in range(4)}  # a shared passage
    texts |= {120: f"{sentence(r, 60)} {item}", 121: f"{sentence(r, 700)} {item} end", 122: item.upper() + " x"}
    texts |= {130: "too short", 131: "", 132: " ".join(["loop around and around again once more now"] * 9), 133: None}
    texts |= {140 + k: sentence(r, 60).replace(" ", " # ") for k in range(3)}
    texts |= {1000 + k: sentence(r, 30) for k in range(400)}
    rows = [(d, t, "en", "s", None if t is None else len(t), "extra", 1) for d, t in texts.items()]
    folder = fresh_folder(spark, "planted")
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, _row int"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    # A labelled holdout large enough for certificates; labels may name a document more than once, which proves nothing.
    labels = [(k % 60, 1, 0) for k in range(3000)] + [(140 + k % 3, 0, 0) for k in range(60)] + [(1000 + k, 1, 0) for k in range(400)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, item


def good(text):
    words = (text or "").split()
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and 100 * symbols <= 30 * len(words)


def bits(text):
    words = (text or "").lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_groups(texts):
    prints = {d: bits(t) for d, t in texts.items()}
    kept, seen = {}, set()
    for d in sorted(texts):
        if d in seen:
            continue
        kept[d], todo = texts[d], [d]
        while todo:
            x = todo.pop()
            for y in texts:
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 2:
                    seen.add(y)
                    todo.append(y)
    return kept


def without_repeats(texts):
    data = {d: (t or "").encode() for d, t in texts.items()}
    counts = Counter(t[i : i + 200] for t in data.values() for i in range(len(t) - 199))
    out = {}
    for d, t in data.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[d] = bytes(b for b, g in zip(t, gone) if not g).decode()
    return out


def without_items(texts, item):
    own = WORD.findall(item)
    runs = {tuple(own[i : i + 13]) for i in range(len(own) - 12)}
    out = {}
    for d, t in texts.items():
        found = list(WORD.finditer(t.lower()))
        words = [m[0] for m in found]
        hit = sorted({p for i in range(len(words) - 12) if tuple(words[i : i + 13]) in runs for p in range(i, i + 13)})
        if not hit or 20 * len(hit) < len(words):
            out[d] = t[: found[hit[0]].start()] + t[found[hit[-1]].end() :] if hit else t
    return out


def test_every_stage(spark, planted):
    folder, texts, item = planted
    want = {d: t for d, t in texts.items() if good(t)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = [lambda x: x, first_of_groups, without_repeats, lambda x: without_items(x, item)]
    for (name, stage), step in zip(cp.STAGES[:-1], plain):
        out = stage(spark, docs, folder)
        want = step(want)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want), name
        assert all(r.n_chars == len(r.text) and r.n_words == "extra" and r["_row"] == 1 for r in rows), name
        path = fresh_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert 1 in want and not {100, 101, 103, 120, 122, 130, 132, 140} & set(want) and 121 in want and 110 in want
    model = sp.model_at(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    got = {r.doc_id: r["ids"] for r in cp.run(spark, folder).collect()}
    assert got == {d: model.encode(t).tolist() for d, t in want.items()}


def test_odd_and_empty_tables(spark, planted, documents, odd_texts):
    folder, *_ = planted
    for docs in (documents(odd_texts, clashing=True), documents([])):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, folder)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= len(odd_texts)
            if name in ("suffixes", "sentencepiece"):
                assert len(rows) == docs.count()
    one = cp.near_duplicates(spark, documents(odd_texts), folder)
    assert one.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()
