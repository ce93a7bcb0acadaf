"""Ranked lexical search against scores computed document by document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from quayside.llm.lexical_search import Search, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, best=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in asked if t in b
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, search=Search()):
    d = spark.createDataFrame([(*r, 1, "x", 3) for r in docs], "doc_id long, text string, n int, terms string, rank int")
    b = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, score int")
    return sorted([tuple(r) for r in ranked(d.repartition(5), b, search).collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "a", "élan", "ÉLAN", "x1", "中文", "rare", *(f"w{i}" for i in range(30))]
    signs = [" ", ", ", "_", "\n", "-"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(signs) for _ in range(k))
    docs = [(i, text(rng.randrange(12))) for i in range(n)]
    docs += [(1000 + i, "the same copy w1 w2") for i in range(60)]
    docs += [(2000 + i, "unknown words only") for i in range(5)] + [(3000, None), (3001, ""), (3002, "... !"), (None, "rare rare w3"), (None, "w4 rare")]
    docs += [(7, "w5 w6"), (7, "w5 w6")]
    items = [(i, text(rng.randrange(8))) for i in range(20)] + [(50, "copy of the same"), (50, "rare"), (51, None), (52, "..."), (None, "w3 W3 w3"), (53, "nowhere")]
    return docs, items


@pytest.mark.parametrize("search", [Search(), Search(table_bytes=0), Search(item_terms=15, cells=50), Search(best=3)])
def test_equals_brute_force(spark, search):
    docs, items = corpus(1, 150)
    assert found(spark, docs, items, search) == brute(docs, items, search.best)


def test_empty_tables(spark):
    docs, items = corpus(2, 10)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_very_long_text(spark):
    docs = [(1, "long " * 500_000 + "end"), (2, "end"), (3, "long")]
    assert found(spark, docs, [(1, "long end")]) == brute(docs, [(1, "long end")])
