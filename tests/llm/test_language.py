import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quayside.llm import language
from quayside.llm.blocks import mix


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    found = {r.doc_id: r for r in language.identified(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert found.keys() == truth.keys()
    assert all(found[i].held_out == held_out(i) for i in truth)
    tested = [i for i in truth if held_out(i)]
    assert np.mean([found[i].lang_pred == truth[i] for i in tested]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_counts_equal_sets_up_to_false_positives():
    model = language.Filter(("a", "b"), np.zeros((1, 1 << 12), np.uint8), np.zeros(2), 4)
    block = next(language.padded_blocks(pa.array(["the cat", "", "der hund"])))
    grams, row = language.grams_of(block, 4)
    data = [b"  the cat  ", b"    ", b"  der hund  "]
    want = [g for d in data for i in range(len(d) - 3) if b"  " not in (g := d[i : i + 4])]
    assert [int(g).to_bytes(4, "big") for g in grams] == want and row.tolist() == [0] * 6 + [2] * 7
    for place in language._places(grams[row == 0], 1 << 12):
        model.slots[0, place] |= 1
    counts = language.corrected_counts(block, model)
    assert counts[0].tolist() == [6, 0] and counts[1].tolist() == [0, 0] and counts[2, 1] == 0
    assert len(set(mix(np.arange(1000)).tolist())) == 1000


def test_nulls_ties_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string, n long, held_out int"
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "s", "p", 1, 1) for i in range(40)]
    rows += [(100, None, "en", None, None, 1, 1), (101, "", "de", None, None, 1, 1), (102, "12 %% 34", None, None, None, 1, 1)]
    rows += [(103, "cat the", None, None, None, 1, 1), (103, "cat the", None, None, None, 1, 1), (None, "und der hund", "de", None, None, 1, 1)]
    rows += [(104, "der " * 700_000, None, None, None, 1, 1), (105, "Ω", None, None, None, 1, 1)]
    got = language.identified(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert pred[100] == pred[101] == pred[102] == "und"
    assert pred[103] == "en" and pred[None] == "de" and pred[104] == "de" and pred[105] in ("de", "en")
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}


def test_no_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identified(empty).collect() == []
    alone = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identified(alone).collect()] == [("und", 0.0)]


def test_over_64_languages_and_the_cap_on_grams(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}qz " * 5, f"l{i:03d}") for i in range(100) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), language.Settings(grams=4))
    assert len(model.languages) == 100 and model.slots.shape[0] == 2
    pred = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(pred[i] == f"l{i:03d}" for i in range(100))


def test_a_rare_language_is_in_a_bounded_sample(spark):
    texts = {"en": "the cat sat on the mat", "de": "der hund und die katze", "fi": "kolme pientä kissaa juoksee"}
    rows = [(i, texts[lang], lang) for i, lang in enumerate(["en", "de"] * 2000 + ["fi"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), language.Settings(sample=200))
    assert model.languages == ("de", "en", "fi")
    pred = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(pred[i] == lang for i, _, lang in rows)


def test_rows_a_language_use_the_whole_sample():
    assert language.rows_a_language([10, 20], 100) == language.rows_a_language([], 100) == float("inf")
    assert language.rows_a_language([10, 1000, 1000], 210) == 100
    assert language.rows_a_language([1000] * 100, 200) == language.LEAST_ROWS
