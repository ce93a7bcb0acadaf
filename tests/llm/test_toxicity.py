import random
import zlib

import numpy as np
import pytest

from quayside.llm import toxicity

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def logs():
    four = np.zeros((32,) * 4)
    text = b" the idiot sat on a stupid mat and the moron laughed at worthless scum in a letter to all "
    codes = toxicity._SYMBOL[np.frombuffer(text, np.uint8)]
    for k in range(len(codes) - 3):
        four[tuple(codes[k : k + 4])] += 20
    return toxicity.log_probabilities(four)


def brute_decode(text, logs):
    """All readings, one by one."""
    best = None

    def extend(at, state, score, reading):
        nonlocal best
        if at == len(text):
            final = (score + float(logs[state, 0]), -state)
            if best is None or final > best[0]:
                best = (final, reading)
            return
        for letter, cost in toxicity._readings(text, at):
            symbol = toxicity._symbol(letter) if letter else -1
            if symbol < 0 or (symbol == 0 and state % 32 == 0):
                extend(at + 1, state, score + cost, reading)
            else:
                extend(at + 1, (state * 32 + symbol) % 32**3, score + cost + float(logs[state, symbol]), reading + letter)

    extend(0, 0, 0.0, "")
    return best[1].strip()


@pytest.mark.parametrize("text", ["1d10t", "$tup1d", "m0r0n", "sc_um", "i d i o t", "idiooot", "s.t.u.p.i.d", "w0rthl355", "a 1 !", "4ll-l3tt3r", "é1!"])
def test_viterbi_finds_the_best_of_all_readings(logs, text):
    assert toxicity.decode(text, logs) == brute_decode(text, logs)


def test_disguises_are_read(logs):
    reader = toxicity.Reader(logs, lambda w: (w,))
    for text, word in [("you 1d10t!", "idiot"), ("a $tup1d mat", "stupid"), ("(m0r0n)", "moron"), ("i d i o t here", "idiot"), ("idiooooot", "idiot"), ("s-c-u-m", "scum"), ("MORON###", "moron")]:
        assert word in reader.read(text)[1], text
    assert reader.read("the letter to all") == (4, ["the", "letter", "to", "all"])
    assert reader.read("") == (0, [])


@pytest.mark.parametrize(
    "token,word",
    [("a$$", "ass"), ("dumba$$", "dumbass"), ("4$$", "ass"), ("455", "ass"), ("$1+", "sit"), ("iidiiot", "idiot"), ("1d10t!", "idiot"), ("f00!", "fool"), ("moron$$", "moron"), ("A$$!", "ass"), ("4$$!!", "ass"), ("moron$$!", "moron")],
)
def test_short_and_whole_disguises_are_read(token, word):
    four = np.zeros((32,) * 4)
    codes = toxicity._SYMBOL[np.frombuffer(b" the ass and a dumbass sit with the idiot moron and a fool " * 2, np.uint8)]
    for k in range(len(codes) - 3):
        four[tuple(codes[k : k + 4])] += 20
    reader = toxicity.Reader(toxicity.log_probabilities(four), lambda w: (w,))
    assert word in reader.read(f"you {token} here")[1]


def test_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    tested = [i for i in truth if got[i].held_out]
    hits = [got[i].predicted == truth[i] for i in tested]
    caught = [got[i].predicted for i in tested if truth[i]]
    assert np.mean(hits) > 0.97 and np.mean(caught) > 0.8


def toy():
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(30))
    docs = [(i, prose() + (" you idiot fool " if i % 3 == 0 else " you kind ") + prose()) for i in range(300)]
    return docs, [(i, 1, int(i % 3 == 0)) for i in range(300)]


def test_nulls_ties_empty_and_clashing_columns(spark):
    docs, labels = toy()
    docs += [(900, None), (901, ""), (902, "you idiot"), (902, "you idiot"), (None, "plain words"), (903, "word " * 400_000), (904, "1d10t")]
    labels += [(0, 1, 0), (0, 1, 1), (5, None, None), (None, 1, 1), (7777, 0, 1)]
    frame = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in docs], DOCS + ", score double, predicted int, toxic string")
    got = toxicity.scored(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == by[None].predicted == by[903].predicted == 0
    assert by[900].score == by[901].score


def test_no_rows_and_no_labels(spark):
    docs, _ = toy()
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.scored(empty, none).collect() == []
    got = toxicity.scored(spark.createDataFrame(docs, DOCS), none).collect()
    assert len(got) == 300 and {r.score for r in got} == {0.5}
    clean = spark.createDataFrame([(i, 1, 0) for i in range(300)], LABELS)
    assert {r.predicted for r in toxicity.scored(spark.createDataFrame(docs, DOCS), clean).collect()} == {0}


def test_long_tokens_cost_their_length():
    import time

    reader = toxicity.Reader(None, lambda word: ())
    start = time.time()
    assert reader.words_of("ab" * 200_000) == ["ab" * 200_000]
    assert toxicity.cores("a" + "." * 400_000 + "a")[0].count(".") == 400_000
    assert toxicity.cores("." * 400_000 + "(a$$.")[1:] == ["(a$$", "(a"]
    assert time.time() - start < 5


def test_marks_around_a_token():
    assert toxicity.cores("...a!b!,") == ["a!b!", "a!b", "a!b"]
    assert toxicity.cores("a$$!") == ["a$$!", "a$$", "a"]
    assert toxicity.cores("$$$") == ["$$$", "$$$", "$$$"]
    assert toxicity.cores("") == ["", "", ""] and toxicity.cores("-_-") == ["_", "_", "_"]
    assert toxicity.is_traced("a1") and toxicity.is_traced("aa") and not toxicity.is_traced("abab") and not toxicity.is_traced("-.")


def test_words_that_cannot_have_a_stem_are_not_restored_and_the_others_mean_the_same(logs, monkeypatch):
    model = toxicity.Model({"idi": 2.0, "moron$": 3.0, "scum": 1.0, "as$": 1.5}, (1.0, 1.0, -3.0))
    rnd = random.Random(5)
    tokens = ["(moron)", "iidiot", "idiioot,", "moorron", "scum²", "sc²²um", "asss", "aas", "a$$", "letter", "a"]
    for _ in range(1500):
        word = rnd.choice(["idiot", "moron", "scum", "as", "letter", "to", "éa", "²x"])
        word = "".join(c * rnd.choice((1, 1, 1, 2, 3)) for c in word)
        tokens.append(rnd.choice(["", "", "(", "-", "$", "1"]) + word + rnd.choice(["", "", "", ".", ",)", "$$", "!", "_", "0", "-so"]))
    short, full = toxicity.Reader(logs, model.evidence, model.weights), toxicity.Reader(logs, model.evidence)
    for token in tokens:
        assert short.read(token) == full.read(token), token
    decoded = []
    monkeypatch.setattr(toxicity, "decode", lambda text, *_: decoded.append(text) or text)
    toxicity.Reader(logs, model.evidence, model.weights).read("a letter, [all] sorrow: butter mattress annoo moorron")
    assert decoded == ["moorron"]
