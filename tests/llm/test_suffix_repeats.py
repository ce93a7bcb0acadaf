import hashlib
import random

import pytest

from quayside.llm import suffix_repeats as sr


def brute(rows, length=100):
    """By doc_id (null first) and text: bytes, bytes removed, spans, bytes left."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), {}
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id, text] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def check(spark, rows, length=100, **settings):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "text AS t")
    got = sr.without_repeats(frame, length, carry=("t",), **settings).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id, r.t], r.doc_id


def corpus(seed, alphabet, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(15, 60)) for _ in range(4)]
    rows = []
    for i in range(docs):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(text))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text = text[:cut] + p[a : a + rng.randint(80, 400)] + text[cut:]
        if rows and rng.random() < 0.4:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 6)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(alphabet)
            text = "".join(text)
        rows.append((i * 3, text))
    return rows


@pytest.mark.parametrize("seed, alphabet", [(1, "abcdefghij"), (2, "ab"), (3, "aé한😀"), (4, "a"), (5, "abc\n ")])
def test_random_corpora(spark, seed, alphabet):
    check(spark, corpus(seed, alphabet))


def test_many_batches_and_contexts_by_window(spark, monkeypatch):
    monkeypatch.setattr(sr, "BATCH_BYTES", 3000)
    rows = corpus(6, "abcdefgh", 120)
    check(spark, rows)
    check(spark, rows, most_contexts=2)
    check(spark, rows, most_contexts=0)
    check(spark, rows, length=64)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=1_200_000))
    line = "x" * 30 + "the same line of a hundred and more bytes, found again and again in many documents here " + "y" * 30
    rows = [(1, None), (2, ""), (2, ""), (3, line), (3, line), (4, line[:100]), (5, line[1:101] + line[:99]), (None, line), (None, None)]
    rows += [(7, "b" + line), (7, "a" + line), (8, long), (9, long[300_000:500_000] + line + long[:1000]), (10, "z" * 5000), (11, "z" * 99), (12, "z" * 100)]
    check(spark, rows)


def test_one_passage_in_every_document(spark):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=240))
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    check(spark, [(i, noise(150) + passage + noise(150)) for i in range(400)])


def test_groups_are_maximal_and_complete():
    texts = ["aXcommonY1", "bXcommonY2", "cXcommonZ3", "dQcommonZ4"]
    at = [t.index("common") for t in texts]
    before, after = [t[:a][::-1] for t, a in zip(texts, at, strict=True)], [t[a:] for t, a in zip(texts, at, strict=True)]
    groups = {(left, right, tuple(sorted(g))) for left, right, g in sr.maximal_repeats(before, after, 6)}
    assert groups == {(0, 6, (0, 1, 2, 3)), (1, 6, (0, 1, 2)), (1, 7, (0, 1)), (0, 7, (2, 3))}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sr.repeat_digests(empty).collect() == []
    rows = [(1, "abc" * 50, 1, 2, "t", b"k")]
    clash = spark.createDataFrame(rows, "doc_id long, text string, batch long, n_bytes int, to string, kept binary")
    found = sr.repeat_digests(clash).collect()
    kept = brute([(1, "abc" * 50)])[1, "abc" * 50][3]
    assert found[0].kept_sha256 == hashlib.sha256(kept).hexdigest()
    with pytest.raises(ValueError):
        sr.without_repeats(clash, carry=("kept",))
