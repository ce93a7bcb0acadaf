import base64
import hashlib
import random

import public_tokenizers
import numpy as np
import pytest
import tiktoken

from quayside.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return byte_bpe.vocabulary(byte_bpe.read_ranks(PATH), PATTERN)


def ids(words, text):
    return [i for piece in words.encode(text) for i in piece]


def test_every_character_between_others(known, words):
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000 or 0x30000 <= code < 0xE0000 or code > 0xE1000:
            continue
        if code > 0x3000 and code % 7 and not 0xFE00 <= code < 0x10000:
            continue
        text = f"a {chr(code)}{chr(code)} 1{chr(code)}\n"
        assert ids(words, text) == known.encode_ordinary(text), hex(code)


@pytest.mark.parametrize("alphabet", ["ab", "aeinrst", "abcdefghij ", " \n\t'sdre", "é한ñ😀a ", "0123 ", "=-*#! "])
def test_random_texts(known, words, alphabet):
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 5, 8, 20, 100, 400] * 12:
        text = "".join(rng.choices(alphabet, k=n))
        assert ids(words, text) == known.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_000, "-=" * 9_000, "ab" * 10_000])
def test_long_pieces(known, words, text):
    assert ids(words, text) == known.encode_ordinary(text)


def test_rows(spark, known):
    rows = [(1, "The quick\n\nbrown fox's"), (2, None), (3, ""), (3, ""), (None, "naïve 😀"), (5, "word " * 50_000)]
    got = byte_bpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        tokens = known.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        want.append((doc_id, len(tokens), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.token_digests(empty, PATH, PATTERN).collect() == []
    clash = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, ids string")
    with pytest.raises(ValueError):
        byte_bpe.encode(clash, PATH, PATTERN)
    assert byte_bpe.encode(clash, PATH, PATTERN, into="tokens").columns == ["doc_id", "text", "ids", "tokens"]
    assert byte_bpe.token_digests(clash, PATH, PATTERN).count() == 1


def test_remembered_pieces_and_decoded_ids(words):
    text = "some words, some more words \u00e9\u4e2d " * 50
    for _ in range(2):
        ids = np.frombuffer(words.ids(text), np.int32)
        assert ids.tolist() == [i for piece in words.encode(text) for i in piece]
    data, sizes = words.decode(ids)
    assert data.tobytes().decode() == text and sizes.sum() == len(text.encode())
    assert words.decode(ids[:0])[0].size == 0 and words.ids("") == b""
    for wrong in (-1, 10**6):
        with pytest.raises(KeyError):
            words.decode(np.array([wrong]))


def test_pieces_are_forgotten_beyond_the_limit(words, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 10)
    for i in range(40):
        text = f"piece {i} and {i * 7} others"
        assert np.frombuffer(words.ids(text), np.int32).tolist() == [n for piece in words.encode(text) for n in piece]
