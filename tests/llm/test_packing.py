"""Packing: whole documents by the tokenizer itself, windows without gaps, sums of squares against all choices."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quayside.llm.packing import Packer, Packing, Piece, Words, packed, read_tokenizer
from quayside.llm.queries import TOKENIZER

WHOLE = Tokenizer.from_file(TOKENIZER)


def ids_of(text: str | None) -> list[int]:
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check(rows, docs: list[tuple], window: int) -> None:
    """All that the contract fixes, for documents with different ids."""
    want = {d: [*ids_of(t), 1] for d, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[d])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)


TEXTS = [
    "", None, " ", "a", "a  b", "a \n b", "it's a 'll <|endoftext|> y<|endoftext|>z ", "é à 中 文　x   y", "x " * 5000, "same text", "same text",
    "z" * 30_000, "tab\t x \x85 y", "word " * 900,
]


def test_ids_equal_the_tokenizer_on_whole_texts(spark):
    words, rng = Words(read_tokenizer(TOKENIZER)), random.Random(5)
    signs = [" ", " ", "a", "é", "\n", "\t", " ", " ", "'s", ".", "1", "中", "<|endoftext|>", "\x85", "　", "b", "\x1c"]
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(3000)]
    for _ in range(2):  # met for the first time, and remembered
        got = dict(words.encode(pa.array(texts, pa.string())))
        assert [got[i].tolist() for i in range(len(texts))] == [ids_of(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, own = Words(read_tokenizer(path)), Tokenizer.from_file(path)
    assert not words.by_words
    texts = ["Some words, and  MORE", "", "x y"]
    assert [ids.tolist() for _, ids in words.encode(pa.array(texts))] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("packing", [Packing(), Packing(window=64), Packing(window=64, most_open=2), Packing(window=8, most_open=1)])
def test_every_id_lies_in_one_piece(spark, packing):
    docs = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, sequence_id string, length int")
    check(packed(frame, TOKENIZER, packing).collect(), docs, packing.window)


def test_empty_table_and_repeated_ids(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packed(frame, TOKENIZER).count() == 0
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id int, text string").coalesce(1)
    rows = packed(frame, TOKENIZER).collect()
    assert sum(r.length for r in rows) == 8 and sum(r.start == 0 for r in rows) == 4


def test_level_leaves_least_sum_of_squares():
    rng, packer = random.Random(3), Packer(Packing(window=24))
    for _ in range(2000):
        n = rng.randint(1, 23)
        counts = packer.counts.copy()

        def squares(level: int) -> int:
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + n < 24:
                after[level + n] += 1
            return int((after**2).sum())

        usable = [h for h in range(0, 25 - n) if h == 0 or counts[h]]
        assert packer.level_for(n) == min(usable, key=lambda h: (squares(h), -h))
        packer.add(Piece(0, 0, bytes(4 * n), n))
        assert packer.open == packer.counts.sum()
    packer.finish()
    sizes = [sum(map(len, w)) for w in packer.done]
    assert all(s == 24 or s & (s - 1) == 0 for s in sizes) and sum(s != 24 for s in sizes) <= 5


def test_few_documents_are_cut(spark):
    """Only as many as are longer than a window or complete the last windows."""
    rng, packer = random.Random(4), Packer(Packing(window=2048))
    for i in range(20_000):
        n = rng.randint(1, 2047)
        packer.add(Piece(i, 0, bytes(4 * n), n))
    open_windows = packer.open
    packer.finish()
    cuts = sum(map(len, packer.done)) - 20_000
    assert cuts <= open_windows + 11 and cuts < 0.15 * 20_000
