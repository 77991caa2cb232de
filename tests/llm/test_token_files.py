import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnsift.llm import token_files as tf
from turnsift.session import fresh_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 11, 15, 16, 17, 31, 32])
def test_packing(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 4096, 5003):
        ids = r.integers(0, 1 << bits, n).astype(np.uint32)
        packed = tf.pack(ids, bits)
        assert len(packed) == 8 * ((n * bits + 63) // 64 + 1)
        for a, b in ((0, n), (n // 3, n), (n // 2, n // 2), (64 if n > 64 else 0, n)):
            assert (tf.unpack(packed, bits, a, b - a) == ids[a:b]).all()


def test_bits():
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  1,.'!\n\t\x1c\x85\xa0　é日s")), max_size=60))
def test_pieces_encode_like_the_whole_text(text):
    whole = tf._tokenizer(PATH).encode(text, add_special_tokens=False).ids
    coded = tf._encoder(PATH).encode(pa.array([text, "x " + text, ""]), 7)
    assert coded[0].tolist() == [*whole, 7] and coded[2].tolist() == [7]
    assert coded[1].tolist() == [*tf._tokenizer(PATH).encode("x " + text, add_special_tokens=False).ids, 7]


def test_control_strings_are_what_the_library_takes_them_for():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "no <|end of|> it", "x  <|endoftext|>  y <|endoftext|>"]
    coded = tf.PieceEncoder(PATH).encode(pa.array(texts), 7)
    assert [c.tolist() for c in coded] == [[*plain.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert coded[0].tolist() == [31373, 220, 50256, 995, 7]


def test_long_pieces_are_not_kept():
    encoder = tf.PieceEncoder(PATH)
    texts = [c * 2000 + "!" for c in "日本語文字列"] + ["word " + c * 3000 + ".,." for c in "abcde"] + ["short text here"]
    coded = encoder.encode(pa.array(texts), 7)
    assert [c.tolist() for c in coded] == [[*tf._tokenizer(PATH).encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert all(len(p) <= tf.LONG_PIECE for kept in (encoder.known, encoder.heads, encoder.tails) for p in kept)
    assert "here" in encoder.known


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  ,.!|'é\n\t7")), max_size=40), min_size=1, max_size=6))
def test_texts_encoded_together_are_those_encoded_alone(texts):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tf, "PIECES", 20)
        patch.setattr(tf, "TOGETHER", 3)
        encoder = tf.PieceEncoder(PATH)
        for some in (texts, texts[::-1], [*texts, "a|b <|endoftext|> c"]):
            want = [[*tf._tokenizer(PATH).encode(t, add_special_tokens=False).ids, 7] for t in some]
            assert [c.tolist() for c in encoder.encode(pa.array(some), 7)] == want


def test_frequent_pieces_go_to_the_library_once_and_new_ones_in_short_texts(monkeypatch):
    monkeypatch.setattr(tf, "PIECES", 400)
    encoder = tf.PieceEncoder(PATH)
    sent, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: sent.extend(texts) or library(texts))
    for k in range(20):
        text = "A common, " + " ".join(f"word{k}x{n}" for n in range(150)) + " end.  Odd common! and common"
        coded = encoder.encode(pa.array([text, "A common."]), 7)
        assert coded[0].tolist() == [*tf._tokenizer(PATH).encode(text, add_special_tokens=False).ids, 7]
        assert len(encoder.known) + len(encoder.older) < 2 * 400
    words = [word for text in sent for word in text.split()]
    assert words.count("common") == 1 and len(words) == len({*words}) == 20 * 150 + len("A . , ! end. Odd and".split()) + 1
    assert max(len(text.split()) for text in sent) <= 200


def test_round_trip(spark, documents, odd_texts, monkeypatch):
    rows = odd_texts
    folder = fresh_folder(spark, "tokens")
    tf.write_tokens(documents(rows, clashing=True).repartition(3), folder, PATH, 50_257)
    got = [tuple(r) for r in tf.token_digests(tf.read_blocks(spark, folder)).collect()]
    want, start = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*tf._tokenizer(PATH).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [len(x) for x in tf.fetch(spark, folder, 9)] == [n for d, _, n, _ in want if d == 9]


def test_blocks_hold_whole_documents():
    made = list(tf._blocks(3, 20, iter([(k, np.arange(n, dtype=np.uint32)) for k, n in enumerate([200_000, 100_000, 300_000, 1, 0])])))
    assert [b["doc_ids"] for b in made] == [[0], [1], [2], [3, 4]]
    assert [b["first"] for b in made] == [0, 200_000, 300_000, 600_000]
    assert [x.tolist()[-1:] for b in made for _, _, x in tf.document_ids(b)] == [[199_999], [99_999], [299_999], [0], []]


def test_empty_table(spark, documents):
    folder = fresh_folder(spark, "tokens")
    tf.write_tokens(documents([]), folder, PATH, 50_257)
    assert tf.read_blocks(spark, folder).count() == 0
