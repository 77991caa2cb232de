import random

import numpy as np
import public_tokenizers
import pytest

from turnsift.llm import pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sp.model_at(PATH)


def brute(model, text):
    """Best path over the whole text, trying every piece at every place."""
    text = " " + text
    numbers = {c.decode(): i for i, c in enumerate(model.content) if c and i not in set(model.byte_ids)}
    best, path = [0.0], [()]
    for end in range(1, len(text) + 1):
        raw = text[end - 1].encode()
        score, ids = best[end - 1] + model.fallback * len(raw), path[end - 1] + tuple(model.byte_ids[b] for b in raw)
        for size in range(min(16, end), 0, -1):
            number = numbers.get(text[end - size : end])
            if number is not None and best[end - size] + model.scores[number] > score:
                score, ids = best[end - size] + model.scores[number], path[end - size] + (number,)
        best.append(score)
        path.append(ids)
    return list(path[-1])


def test_against_all_paths(model):
    r = random.Random(1)
    texts = ["a", "  a  b \n c\td  ", " lead", "▁x ▁▁ y", "\n\n", "é　日本 𝒳", "the  cat\nsat. ", " ", "x" * 60 + " " + "ab " * 5]
    texts += ["".join(r.choice("ab  \n▁é.th") for _ in range(r.randrange(1, 30))) for _ in range(80)]
    for text in texts:
        assert model.encode(text).tolist() == brute(model, text)
        assert model.decode(model.encode(text)) == text


def test_cutting_and_keeping_change_nothing(model, monkeypatch):
    text = "the cat sat on the mat, the   end\n" * 3
    whole = np.frombuffer(b"".join(model.path(x) if x != "\n" else model.line_feed for x in [" " + text[:33], "\n"]), "<i4")
    assert model.encode(text)[: len(whole)].tolist() == whole.tolist()
    monkeypatch.setattr(sp, "KEPT", 0)
    again = model.encode(text)
    assert model.decode(again) == text


def test_round_trip(documents, odd_texts):
    encoded = sp.encode_pieces(documents(odd_texts, clashing=True), PATH, verify=True)
    back = sp.decode_pieces(encoded.withColumnRenamed("text", "was"), PATH).collect()
    assert [r.text for r in back] == [r.was for r in back] == [t for _, t in odd_texts]
    assert all((r.ids is None) == (r.was is None) and (r.was != "" or r.ids == []) for r in back)
    assert {r.round_trip for r in sp.piece_digests(encoded, PATH).collect()} == {True}
    assert sp.encode_pieces(documents([]), PATH).count() == 0


def test_score_is_the_sum_of_the_pieces(model, documents):
    row = sp.encode_pieces(documents([(1, "hello there")]), PATH).first()
    assert row.score == sum(model.scores[row.ids])


def test_long_words_are_not_kept():
    model = sp.PieceModel.load(PATH)
    texts = [" ".join([c * 4000, "word", c * 3000 + "x"]) for c in "abcdefgh"]
    for text in texts:
        assert model.decode(model.encode(text)) == text
    assert max(map(len, (*model.kept, *model.spaced))) <= sp.LONGEST_KEPT and "word" in model.spaced
