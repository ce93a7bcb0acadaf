import random
import re
import string
from collections import defaultdict

import pyarrow as pa
import pytest

from quayside.llm import minhash_forest as mf
from quayside.llm.blocks import blocks

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id to (component, set sizes), by shared shingles of all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    index = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        if d is None:
            continue
        for x in s:
            for j in index[x]:
                shared[j] += 1
            index[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(d), find(sets[j][0])))
                root[b] = a
    return {d: find(d) for d in root}


def check(spark, rows, forest=mf.Forest()):
    got = mf.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), forest).collect()
    want = brute(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((d, len(shingles(t))) for d, t in rows if d is not None)
    wrong = [(r.doc_id, r.component_id, want[r.doc_id]) for r in got if r.doc_id is not None and r.component_id != want[r.doc_id]]
    assert not wrong, wrong[:5]
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def copies(seed, groups=40, most=12, passage=True):
    rng = random.Random(seed)
    common, rows = prose(rng, 40), []
    for _ in range(groups):
        base = prose(rng, rng.randint(30, 300))
        n = rng.randint(1, most)
        for _ in range(n):
            text = edited(rng, base, rng.randint(0, 1 + len(base.split()) // 30))
            rows.append(text + (" " + common if passage and rng.random() < 0.3 else ""))
    rng.shuffle(rows)
    return [(7 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_of_all_degrees(spark, seed):
    check(spark, copies(seed))


def test_a_large_group_across_blocks_and_runs(spark):
    rng = random.Random(5)
    base = prose(rng, 200)
    rows = [(i, edited(rng, base, rng.randint(0, 5))) for i in range(500)] + [(1000 + i, prose(rng, 100)) for i in range(200)]
    rows += [(2000 + i, base) for i in range(300)]
    check(spark, rows, mf.Forest(block=40))


def test_a_chain_and_the_threshold(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(w[8 * i : 8 * i + 104])) for i in range(30)]
    sixteen = [f"x{i}" for i in range(20)]
    rows += [(200, " ".join(sixteen)), (201, " ".join(sixteen[:16]))]  # 12 of 16 shingles
    rows += [(300, " ".join(sixteen).replace("x", "y")), (301, " ".join(sixteen[:15]).replace("x", "y"))]  # 11 of 16
    check(spark, rows)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rng = random.Random(8)
    long = prose(rng, 120_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "two one"), (8, "a b c d e"), (8, "a b c d e")]
    rows += [(None, "a b c d e"), (None, None), (9, "A B C D E"), (10, long), (11, edited(rng, long, 100)), (12, "x" * 100_000)]
    rows += [(13, "p q r s t"), (13, "u v w x y"), (14, "p q r s t"), (15, "u v w x y")]
    check(spark, rows)


def test_sets_across_rows_and_blocks():
    texts = ["a b c d e f", "", "a b", None, "a b c d e", "a b a b a b a b", "b a"]
    for limit in (1, 9, 1000):
        sets = []
        for block in blocks(pa.array(texts), limit):
            values, sizes = mf.shingle_sets(block)
            at = 0
            for n in sizes:
                sets.append(set(values[at : at + n].tolist()))
                at += n
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
        assert sets[4] < sets[0] and sets[2] != sets[6]


def test_empty_table_and_clashing_columns(spark):
    assert mf.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a b", 1, "r"), (2, "a b", 1, "r")], "doc_id long, text string, low long, root string")
    assert {r.component_id for r in mf.near_duplicates(clash).collect()} == {1}


def test_the_tables_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def crowd(seed, n):
    """n documents at 0.729 to each other, two of them at 0.752: the template, a few words of their own pair, own words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=9))
    template, pair = [word() for _ in range(404)], [word() for _ in range(7)]
    rows = [(i, " ".join(template + (pair + [word() for _ in range(67)] if i in (17, n - 5) else [word() for _ in range(74)]))) for i in range(n)]
    return rows


@pytest.mark.parametrize(("seed", "n"), [(1, 1000), (2, 1000), (3, 1000), (4, 4000), (5, 4000)])
def test_a_linked_pair_in_a_crowd_just_below_the_threshold(spark, seed, n):
    rows = crowd(seed, n)
    a, b, c = (shingles(rows[i][1]) for i in (17, n - 5, 3))
    assert 0.75 < len(a & b) / len(a | b) < 0.754 and 0.728 < len(a & c) / len(a | c) < 0.73
    got = {r.doc_id: r.component_id for r in mf.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 17 if i == n - 5 else i for i in range(n)}


def test_shared_counts_rare_and_common_elements():
    rng = random.Random(9)
    sets = [set(rng.sample(range(60), rng.randrange(30))) | ({100 + i // 20}) for i in range(50)] + [set()]
    values = mf.np.array([x for s in sets for x in sorted(s)], mf.np.uint64)
    common = mf.shared(values, mf.np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        assert all(common[i, j] == len(a & b) for j, b in enumerate(sets) if i != j)


def test_windows_bounded_by_rows_and_by_shingles(spark):
    rng = random.Random(11)
    base = prose(rng, 400)
    rows = [(i, edited(rng, base, rng.randint(0, 8))) for i in range(300)]
    check(spark, rows, mf.Forest(shingles=16_000))
    check(spark, rows, mf.Forest(rounds=()))


@pytest.mark.parametrize("spread", [1, 4])
def test_regions_larger_than_a_block_are_compared_in_full(spark, spread):
    rng = random.Random(spread)
    # all share a long passage; copies lie far apart in every order, as the keys of a region are equal
    passage = prose(rng, 70)
    own = [prose(rng, 40) for _ in range(24)]
    rows = [(i + 24 * k, f"{passage} {edited(rng, text, 1)}") for k in range(2) for i, text in enumerate(own)]
    rows += [(100 + i, f"{passage} {edited(rng, own[0], 1)}") for i in range(12)]
    check(spark, rows, mf.Forest(trees=20, depth=2, block=4 * spread))


def test_pairs_meet_in_one_small_region_and_only_if_not_connected(spark):
    big = [(2, 5, 50, 20, 100 + i, None) for i in range(20)]
    rows = [
        (1, 1, 10, 3, 1, None), (1, 1, 10, 3, 2, None), (1, 1, 10, 3, 3, None),
        (2, 2, 20, 2, 1, None), (2, 2, 20, 2, 2, None),  # met in tree 1
        (2, 2, 21, 3, 1, None), (2, 2, 21, 3, 2, None), (2, 2, 21, 3, 4, None),  # 4 is new
        (3, 3, 30, 2, 5, None), (3, 3, 30, 2, 6, None),  # one component
        (3, 3, 31, 2, 7, None), (3, 3, 31, 2, 7, None),  # one document
    ]
    regions = spark.createDataFrame(rows + big, "tree int, block long, region long, members long, doc_id long, whole binary")
    ids = sorted({r[4] for r in rows + big})
    roots = spark.createDataFrame([(i, 5 if i == 6 else i) for i in ids], "doc_id long, root long")
    got = sorted(tuple(r) for r in mf.first_meetings(regions, roots).collect())
    want = [(1, 1, 10, i) for i in (1, 2, 3)] + [(2, 2, 21, i) for i in (1, 2, 4)] + [(2, 5, 50, 100 + i) for i in range(20)]
    assert got == want


def test_near_misses_are_compared_once(spark, monkeypatch):
    """Pairs below the threshold share first hashes in many trees; their texts go to one of them after the first tree."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = prose(rng, 300)
        rows += [(2 * i, text), (2 * i + 1, edited(rng, text, 10))]
    sent, stored = [], mf.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "meetings":
            sent.append(out.where("region IS NOT NULL").count())
        return out

    monkeypatch.setattr(mf, "stored", counted)
    check(spark, rows)
    # the turns of trees after the first; regions cut by a border are compared in full after them
    assert 0 < sum(sent[1:4]) <= 2 * 60


def test_possibly_keeps_all_that_are_named_and_few_others(spark):
    from quayside.llm.blocks import possibly

    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ids = df.where("doc_id % 10 = 3")
    found = possibly(df, ids)
    assert found.columns == ["doc_id"] and found.join(ids, "doc_id", "left_semi").count() == 2000
    assert found.count() < 2000 + 18_000 * 0.2
    assert possibly(df, ids.limit(0)).count() == 0
