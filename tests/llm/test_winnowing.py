import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quayside.llm import winnowing


@pytest.fixture(scope="module")
def hash_of(spark):
    known = {}

    def many(grams):
        new = [g for g in set(grams) if g not in known]
        if new:
            rows = spark.createDataFrame([(g,) for g in new], "g string").select("g", F.shiftrightunsigned(F.xxhash64("g"), 32).alias("h")).collect()
            known.update((r.g, r.h) for r in rows)
        return [known[g] for g in grams]

    return many


def brute(text, hash_of, gram, window):
    """(hash, position) chosen by each window in turn, without repetition."""
    if not text:
        return []
    hashes = hash_of([text[i : i + gram] for i in range(len(text) - gram + 1)] if len(text) >= gram else [text])
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        own = [(h, -(i + j)) for j, h in enumerate(hashes[i : i + window])]
        h, position = min(own)
        if (h, -position) not in out[-window:]:
            out.append((h, -position))
    return out


def numbers(fingerprint):
    values = [int(x, 16) for x in fingerprint.split(",")] if fingerprint else []
    return [(v >> 31, winnowing.LAST - (v & winnowing.LAST)) for v in values]


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, hash_of, gram=winnowing.GRAM, window=winnowing.WINDOW):
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), gram, window).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    prints = [brute(t, hash_of, gram, window) for _, t in order]
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        new = brute(edited, hash_of, gram, window)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i], new, alike(prints[i], new), alike(prints[i], prints[(i + 1) % len(order)])))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, numbers(r.fingerprint), numbers(r.edited_fingerprint), r.near_edited, r.near_next) for r in got]
    for h, w in zip(sorted(have, key=str), sorted(want, key=str), strict=True):
        assert h[:3] == w[:3] and h[5:] == w[5:]
        assert sorted(h[3]) == sorted(w[3]) and sorted(h[4]) == sorted(w[4])


@pytest.mark.parametrize("gram, window", [(20, 32), (5, 4), (1, 1), (3, 7), (2, 100)])
def test_random_texts(spark, hash_of, gram, window):
    rng = random.Random(gram)
    rows = [(i, "".join(rng.choices(rng.choice(["ab", "a", "abcdefgh \n", "é한😀b"]), k=rng.choice([0, 1, 2, 5, 18, 19, 20, 21, 50, 51, 52, 60, 200, 400])))) for i in range(80)]
    check(spark, rows, hash_of, gram, window)


def test_pieces_and_ranges(spark, hash_of, monkeypatch):
    monkeypatch.setattr(winnowing, "PIECE", 16)
    monkeypatch.setattr(winnowing, "ROWS_PER_RANGE", 7)
    rng = random.Random(3)
    check(spark, [(i * 5 % 61, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 300)))) for i in range(61)], hash_of)


def test_nulls_ties_repeated_rows_and_long_texts(spark, hash_of):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh 😀", k=60_000))
    rows = [(1, None), (2, ""), (3, "same text " * 9), (3, "same text " * 9), (3, "other"), (None, "no id"), (None, None), (4, long), (5, "a" * 9000)]
    check(spark, rows, hash_of)


def test_one_row_empty_table_and_clashing_columns(spark, hash_of):
    check(spark, [(1, "only one text in the table, which follows itself")], hash_of)
    assert winnowing.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a", 2, "h"), (2, "a", 2, "h")], "doc_id long, text string, range int, head string")
    assert {r.near_next for r in winnowing.fingerprints(clash).collect()} == {1.0}
