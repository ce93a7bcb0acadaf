import random
import re

from quayside.llm import license_scan as ls


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def grams(text):
    w = words(text)
    return set(zip(w, w[1:], strict=False))


def brute_windows(text, threshold):
    """Every window at an anchor's place, by direct comparison."""
    w = words(text)
    for k, (name, wording) in enumerate(ls.TEMPLATES):
        t = words(wording)
        pairs = list(zip(t, t[1:], strict=False))
        by_length = sorted(set(pairs), key=lambda g: (-len(" ".join(g)), " ".join(g)))
        need = next(c for c in range(len(by_length) + 1) if c * (2 - threshold) >= threshold * len(by_length) - 1e-9)
        anchors = set(by_length[: len(by_length) - need + 1])
        places = {}
        for i, g in enumerate(pairs):
            if g in anchors:
                places.setdefault(g, []).append(i)
        starts = {at - i for at, g in enumerate(zip(w, w[1:], strict=False)) for i in places.get(g, ())}
        near = {}
        for s in starts:
            if s >= 0 and s + len(t) <= len(w):
                own = grams(" ".join(w[s : s + len(t)]))
                dice = 2 * len(own & set(pairs)) / (len(own) + len(set(pairs)))
                if dice >= threshold:
                    near[s] = dice
        for s, dice in near.items():
            around = ((near[v], -v) for v in range(s - len(t) + 1, s + len(t)) if v in near)
            if max(around) == (dice, -s):
                yield "window", s, name, k, dice


def brute(rows, threshold=0.8):
    known = [(name, grams(text)) for name, text in ls.TEMPLATES]
    for doc_id, text in rows:
        if text is None:
            continue
        yield from ((doc_id, *w) for w in brute_windows(text, threshold))
        parts = re.split(r"\n[ \t\r]*\n", text)
        units = [("line", i, s) for i, s in enumerate(text.split("\n"))]
        units += [("paragraph", i, s) for i, s in enumerate(parts) if "\n" in s]
        units += [("text", 0, text)] if len(parts) > 1 else []
        for unit, i, s in units:
            if own := grams(s):
                dice, at = max((2 * len(own & t) / (len(own) + len(t)), -k) for k, (_, t) in enumerate(known))
                if dice >= threshold:
                    yield doc_id, unit, i, known[-at][0], -at, dice


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ls.scan(frame).collect()), key=str) == sorted(brute(rows), key=str)


def test_notices_edits_nulls_and_long_texts(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "one"), (None, "Licensed under CC BY-NC 4.0."), (4, "\n\n \n")]
    for i, (_, text) in enumerate(ls.TEMPLATES):
        w = text.split()
        for k in range(4):
            edited = [x if rng.random() > 0.04 * k else "word" for x in w]
            broken = "".join(x + rng.choice([" ", " ", " ", "\n * "]) for x in edited)
            rows.append((10 * i + k, f"Some prose here.\n{' '.join(edited).upper()}\n\n{broken}\n\nmore"))
    rows += [(900, "plain words and lines\n" * 40_000 + "Released under the MIT License."), (900, "All rights reserved. All rights reserved.")] * 2
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = [(1, "All rights reserved.", "x", [1], 2, "u")]
    clash = spark.createDataFrame(row, "doc_id long, text string, license string, grams array<int>, n int, unit string")
    assert [(r.unit, r.license) for r in ls.scan(clash).sort("unit").collect()] == [("line", "proprietary"), ("window", "proprietary")]


def found_in(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license, r.position): r.dice for r in ls.scan(frame).where("unit = 'window'").collect()}


def test_notices_within_lines_and_in_published_layout(spark):
    prose = " ".join(f"word{i}" for i in range(30))
    apache = ls.APACHE_NOTICE.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless required", "\n\n    Unless required")
    gpl = ls.GPL_NOTICE.replace(" This program is distributed", "\n\nThis program is distributed")
    mid = f"{prose} {prose} and Released under the MIT License. {prose}"
    found = found_in(spark, [f"{prose}\n\n# {apache}\n\n{prose}\n", f"{prose}\n{gpl}\n\n{prose}", mid, prose])
    assert found[0, "Apache-2.0", 30] == found[1, "GPL-3.0", 30] == found[2, "MIT", 61] == 1
    assert not any(doc == 3 for doc, _, _ in found)


def test_edited_notices_at_every_place(spark):
    """Up to one word in fifteen changed, dropped or added."""
    rng = random.Random(5)
    texts = []
    for k in range(40):
        w = ls.MIT_TERMS.split()
        for _ in range(len(w) // 15):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["other"], [], [w[at], "more"]])
        texts.append(" ".join([*(f"a{i}" for i in range(k)), *w, *(f"b{i}" for i in range(20))]))
    found = found_in(spark, texts)
    assert {doc for doc, name, _ in found if name == "MIT"} == set(range(40))


def test_pieces_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(ls, "PIECE", 1)
    rng = random.Random(6)
    notices = [text for _, text in ls.TEMPLATES]
    long = " ".join(" ".join(f"w{rng.random()}" for _ in range(rng.randrange(60))) + " " + rng.choice(notices) for _ in range(80))
    check(spark, [(1, long), (2, "all rights reserved " * 900)])


def test_the_tables_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sorted(map(tuple, ls.scan(docs).collect()))
    assert found == sorted(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert found
