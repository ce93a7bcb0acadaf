import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from quayside.llm import decontaminate as dc


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(docs, items, s=dc.Settings()):
    """All passages of all documents against all items, one by one."""
    known = sorted({(i, t) for i, t in items if i is not None and t is not None})
    df = Counter(w for _, t in known for w in set(words(t)))
    mean = max(1, sum(len(words(t)) for _, t in known) / max(1, len(known)))
    weights = []
    for _, t in known:
        tf, n = Counter(words(t)), len(words(t))
        w = {x: math.log(1 + (len(known) - df[x] + 0.5) / (df[x] + 0.5)) * c * (s.k1 + 1) / (c + s.k1 * (1 - s.b + s.b * n / mean)) for x, c in tf.items()}
        weights.append({x: v / sum(w.values()) for x, v in w.items()})
    size = min(1024, max(32, max((len(words(t)) for _, t in known), default=32)))
    out = {}
    for doc_id, text in docs:
        w = words(text)
        for at in range(0, len(w), size):
            passage = w[at : at + 2 * size]
            for (item, t), weight in zip(known, weights, strict=True):
                score = sum(weight.get(x, 0) for x in set(passage))
                if weight and score >= s.threshold - 1e-9:
                    shares = []
                    for part in dc.question_and_answer(t):
                        p = words(part)
                        n = min(s.run, len(p))
                        wanted = runs(p, n)
                        shares.append(len(wanted & runs(passage, n)) / len(wanted) if wanted else 1.0)
                    if min(shares) >= s.overlap:
                        out[doc_id, item] = max(out.get((doc_id, item), (0,)), (score, *shares))
    return out


def check(spark, docs, items, settings=dc.Settings()):
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question, r.answer) for r in dc.matches(frame, table, settings).collect()}
    want = brute(docs, items, settings)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9)
    leaking = {d for d, _ in want}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in dc.without_leaks(frame, table, settings).collect()) == sorted(
        (d is None, d or 0) for d, _ in docs if d not in leaking
    )


def prose(rng, n):
    return " ".join("".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, f"{prose(rng, rng.randint(3, 40)).capitalize()}? {prose(rng, rng.randint(1, 12))}.") for i in range(30)]
    docs = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 300))
        if i % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 10])):
                leak[rng.randrange(len(leak))] = prose(rng, 1)
            leak = leak[: rng.choice([len(leak), len(leak), len(leak) // 2])]
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + " ".join(leak).upper() + " " + text[cut:]
        docs.append((i, text))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_passages(spark, seed):
    check(spark, *corpus(seed))


def test_low_thresholds_and_parts_of_the_index(spark):
    docs, items = corpus(3)
    check(spark, docs, items, dc.Settings(threshold=0.3, overlap=0.1, run=2, items_in_block=3))
    check(spark, docs, items, dc.Settings(part=1500))


@pytest.mark.parametrize("length", [1025, 2500, 5000, 20_000])
def test_copies_of_items_of_any_length_are_found_at_any_offset(spark, length):
    rng = random.Random(length)
    item = f"{prose(rng, length // 2).capitalize()}? {prose(rng, length - length // 2)}."
    items = [(1, item), (2, "What is the name of the tallest peak? It is called Example."), (3, prose(rng, 30))]
    docs = [(i, f"{prose(rng, offset)} {item} {prose(rng, 700)}") for i, offset in enumerate((0, 1, 500, 1023, 1500, length // 2, length - 1))]
    docs += [(100, item), (101, prose(rng, 2 * length)), (102, f"{prose(rng, 3000)} {items[1][1]}")]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.question, r.answer) for r in dc.matches(frame, table).collect()}
    assert found.keys() == {*((i, 1) for i in (*range(7), 100)), (102, 2)}
    assert all(v == pytest.approx((1, 1, 1)) for v in found.values())
    assert [r.doc_id for r in dc.without_leaks(frame, table).collect()] == [101]


def test_nulls_ties_empty_and_long_texts(spark):
    rng = random.Random(4)
    item = "What is the name of the tallest mountain in the range? It is called Éxample peak."
    items = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "..."), (5, "One sentence only here"), (1, "A second text for item one? yes it is.")]
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item.lower()), (4, prose(rng, 100_000) + " " + item + prose(rng, 500)), (5, "x" * 200_000)]
    docs += [(6, "one sentence only here and more words"), (7, "a second text for item one yes it is")]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "what is it here? it is this", 5, "s"), (2, "clean", 6, "t")], "doc_id long, text string, item_id int, score string")
    items = spark.createDataFrame([(9, "What is it here? It is this.", 1.0)], "item_id long, text string, score double")
    assert [tuple(r)[:2] for r in dc.matches(docs, items).collect()] == [(1, 9)]
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 6, "t")]


def test_the_tables_passages(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in dc.matches(docs, items).collect()}
    flat = [(r.doc_id, " ".join(words(r.text))) for r in docs.select("doc_id", "text").collect()]
    whole = {(d, i) for i, t in ((r.item_id, " ".join(words(r.text))) for r in items.collect()) for d, text in flat if t in text}
    assert whole and whole <= found and len(found) < len(whole) * 1.2


def built(items, longest=60):
    frequency = Counter(int(w) for text in items for w in set(dc.words_of([text])[0].tolist()))
    return dc.build(list(enumerate(items)), frequency, len(items), float(longest), dc.segment_of(longest, longest), dc.Settings())


@pytest.mark.parametrize("cells", [1, 7, 300, 5000])
def test_bounds_in_slices_are_those_of_the_whole(monkeypatch, cells):
    rng = random.Random(cells)
    items = [prose(rng, 40) for _ in range(50)]
    text = " ".join([prose(rng, 333), items[3], prose(rng, 77), items[17], items[18]])
    texts = pa.array([text, None, "", items[4], text[::-1], text])
    index = built(items)
    whole = [list(dc.scored(index, block)) for block in dc.lower_blocks(texts)]
    assert sum(map(len, whole)) >= 7
    monkeypatch.setattr(dc, "BOUND_CELLS", cells)
    assert [list(dc.scored(index, block)) for block in dc.lower_blocks(texts)] == whole


def test_a_long_text_and_many_items_take_bounded_memory():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [" ".join(rng.choices(vocabulary, k=12)) + "." for _ in range(30_000)]
    index = built(items, 32)
    text = " ".join([*rng.choices(vocabulary, k=500_000), items[77], *rng.choices(vocabulary, k=200_000)])
    (block,) = dc.lower_blocks(pa.array([text]))
    tracemalloc.start()
    found = [item for _, item, *_ in dc.scored(index, block)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 22 000 segments and 3751 blocks of items are 660 MB of bounds at once
    assert len(text) > 4_000_000 and found and set(found) == {77} and peak < 300 << 20
