import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quayside.llm import backoff
from quayside.llm.blocks import blocks, word_hashes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def brute(rows, order=3, least=1, factor=0.4):
    docs = [(i, split(t)) for i, t in rows]
    counts = Counter(tuple(w[k - n : k]) for _, w in docs for n in range(1, order + 1) for k in range(n, len(w) + 1))
    total = sum(len(w) for _, w in docs)
    for doc_id, w in docs:
        score = 0.0
        for k in range(1, len(w) + 1):
            value = 1.0
            for n in range(min(order, k), 0, -1):
                seen = counts[tuple(w[k - n : k])]
                if n == 1 or seen >= least:
                    value *= seen / (total if n == 1 else counts[tuple(w[k - n : k - 1])])
                    break
                value *= factor
            score += math.log(value)
        yield doc_id, len(w), score, score / len(w) if w else None


def check(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, backoff.scores(frame, **settings).collect()), key=str)
    want = sorted(brute(rows, **({"factor": settings.pop("backoff")} if "backoff" in settings else {}), **settings), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-6, rel=1e-9)
        assert (a[3] is None) == (b[3] is None) and (b[3] is None or a[3] == pytest.approx(b[3], abs=2e-6))


ROWS = [
    (1, "The cat sat on the mat."), (2, "the cat sat on THE hat"), (3, None), (4, ""), (5, " \t\n "), (6, "Cat"),
    (6, "Cat"), (None, "é É é the cat"), (8, "a b a b a b a b"), (9, "ends with space "), (10, "\x0b\x0cx\x1cy"),
    (11, "la " * 100_000), (12, "x" * 300_000),
]


@pytest.mark.parametrize("settings", [{}, {"order": 2}, {"order": 1}, {"order": 5}, {"least": 2}, {"least": 3, "backoff": 0.1}])
def test_against_direct_counts(spark, settings):
    check(spark, ROWS, **settings)


@pytest.mark.parametrize("least", [1, 2])
def test_many_batches(spark, monkeypatch, sf_dir, least):
    monkeypatch.setattr(backoff, "BATCH_BYTES", 20_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, least=least)


def test_words_across_rows_and_blocks():
    texts = ["ab", "ab", "", "a b", None, "b", " ab ", "\n", "AB"]
    for limit in (1, 3, 100):
        found = [word_hashes(b) for b in blocks(pa.array(texts), limit)]
        sizes, hashes = np.concatenate([f[1] for f in found]), np.concatenate([f[0] for f in found])
        assert sizes.tolist() == [1, 1, 0, 2, 0, 1, 1, 0, 1]
        names = ["ab", "ab", "a", "b", "b", "ab", "ab"]
        assert len({(n, h) for n, h in zip(names, hashes.tolist(), strict=True)}) == 3 == len(set(hashes.tolist()))


def test_empty_table_and_clashing_columns(spark):
    assert backoff.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a a", 5, "s")], "doc_id long, text string, batch int, score string")
    assert [r.n_tokens for r in backoff.scores(clash).collect()] == [2]
