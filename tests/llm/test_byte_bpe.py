import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tesselark.llm import byte_bpe
from tesselark.llm.bytecols import text_bytes

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.TOKENIZER), reason="no tokenizer here")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(*byte_bpe.ByteBpe.read(byte_bpe.TOKENIZER))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encode(bpe, texts):
    ids, ends = bpe.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_edge_cases(bpe, public):
    texts = ["", None, " ", "\n", "'", "''s", "'s", "x's y'all we'll 'd's 'sure", " 'tis", "a  b\n\n c \t d   ", "aaa" * 300, "!!", "!" * 99, "<|endoftext|>", "日本語 テキスト　全角", "🙂👍🏽🏳️‍🌈", "a\x00b\x00", "é" * 200, " x", "١٢٣ Ⅻ ²", "ﬁ ﬂ", "\r\n\r\n x", "x\n", "tabs\t\tand  spaces "]
    assert encode(bpe, texts) == public(texts)


def test_every_character(bpe, public):
    texts = [f"{chr(i)}a {chr(i)}{chr(i)}1'{chr(i)}" for i in range(1, 0x3400)] + [f" {chr(i)}" for i in range(0x1F300, 0x1FA00)]
    assert encode(bpe, texts) == public(texts)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(bpe, public, seed):
    r = random.Random(seed)
    alphabet = " 'sdtrelvmLD\n\t ab1! é中\u3000\u200b🙂"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    assert encode(bpe, texts) == public(texts)


def test_long_texts(bpe, public):
    texts = ["ab" * 50_000, "word " * 100_000, "ไม่มีช่องว่าง" * 2000]
    assert encode(bpe, texts) == public(texts)


def test_column(spark, public):
    data = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x"), (None, "a", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = byte_bpe.encode_column(df, "doc_id", "text").collect()
    assert [(r.doc_id, r.ids) for r in got] == [(d[0], i) for d, i in zip(data, public([d[1] for d in data]), strict=True)]
    assert byte_bpe.encode_column(df.where("false"), "doc_id", "text").collect() == []


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "0123456789", "a", "ab", "бвгд", "=-"])
def test_long_pieces_take_time_in_proportion(bpe, public, alphabet):
    """A megabyte without a space, beyond any matrix: equal, and far from quadratic (a quarter would take a 16th then)."""
    r = random.Random(2)
    text = "".join(r.choice(alphabet) for _ in range(1 << 20))
    start = time.perf_counter()
    got = encode(bpe, [text])
    assert time.perf_counter() - start < 20
    assert got == public([text])


def test_lengths_around_the_widest_matrix(bpe, public):
    r = random.Random(3)
    texts = ["".join(r.choice(al) for _ in range(n)) for n in range(byte_bpe.WIDEST - 3, byte_bpe.WIDEST + 60) for al in ("ehst", "01", "ж", "e")]
    assert encode(bpe, texts) == public(texts)


def test_a_vocabulary_whose_merges_make_room_for_lower_ranks():
    """There the ranks of a long piece cannot be taken in order: 'ab' joins after 'abc' could, so one pair at a time it is."""
    ids = np.arange(256, dtype=np.int32)
    pairs, made = np.array([[256, ord("c")], [ord("a"), ord("b")]]), np.array([257, 256])
    odd = byte_bpe.ByteBpe(ids, pairs, made, np.full(0x110000, byte_bpe.LETTER, np.uint8))
    assert not odd.ordered
    text = "abc" * 60 + "x"
    got, _ = odd.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert got.tolist() == [257] * 60 + [ord("x")]
