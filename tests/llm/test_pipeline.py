import hashlib

import pyarrow as pa
from test_byte_bpe import known  # noqa: F401
from test_decontaminate import brute as leaks
from test_minhash_forest import brute as groups
from test_suffix_repeats import brute as repeats

import corpus_pipeline as cp
from quayside.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, sf_dir, known):  # noqa: F811
    """Each stage on the rows the one before it kept, whole texts, all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(cp.STAGES)

    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rejected = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    found = {r.doc_id: r for r in kept.collect()}
    assert found == {i: r for i, r in rows.items() if i not in rejected}

    docs, rows = spark.createDataFrame(list(found.values()), DOCS), found
    found = {r.doc_id: r for r in stages["minhash_forest"](spark, docs, sf_dir).collect()}
    root = groups([(i, r.text) for i, r in rows.items()])
    assert found == {i: r for i, r in rows.items() if root[i] == i}

    docs, rows = spark.createDataFrame(list(found.values()), DOCS), found
    found = {r.doc_id: r for r in stages["suffix_repeats"](spark, docs, sf_dir).collect()}
    left = repeats([(i, r.text) for i, r in rows.items()])
    assert {i: r.text for i, r in found.items()} == {i: left[i, r.text][3].decode("utf-8", "ignore") for i, r in rows.items()}
    assert all(r.n_chars == len(r.text) and r.lang == rows[i].lang and r.source == rows[i].source for i, r in found.items())

    docs, rows = spark.createDataFrame(list(found.values()), DOCS), found
    found = {r.doc_id: r for r in stages["decontaminate"](spark, docs, sf_dir).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaking = {d for d, _ in leaks([(i, r.text) for i, r in rows.items()], items)}
    assert found == {i: r for i, r in rows.items() if i not in leaking}

    for r in stages["byte_bpe"](spark, spark.createDataFrame(list(found.values()), DOCS), sf_dir).collect():
        ids = known.encode_ordinary(found[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())

    whole = {r.doc_id for r in cp.run(spark, sf_dir).collect()}
    assert whole == set(found)


def test_stages_keep_nulls_and_repeated_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a few words of text", "en", None, 19), (3, "a few words of text", "en", None, 19), (None, "no id at all here", "en", "s", None)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), DOCS)
        assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), key=str) == sorted((r[:4] for r in rows), key=str)
    assert docs.count() == 5 and cp.STAGES[-1][1](spark, docs, sf_dir).count() == 5


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_a_task_of_a_stage_has_one_python_process(spark, sf_dir):
    """Each one holds its own tables; a chain of them in a task would hold them all at once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("decontaminate", "byte_bpe"):
        plan = dict(cp.STAGES)[name](spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan, name
    plan = cp.new_text(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_a_stage_hands_python_a_bounded_batch_of_long_texts(spark, sf_dir):
    """A batch of ten thousand long texts would be held several times, by the JVM and by Python."""

    def sizes(batches):
        return (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches)

    for name, stage in cp.STAGES:
        bare = spark.newSession()
        docs = bare.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 1000) AS text", "'en' AS lang", "'s' AS source", "11000L AS n_chars")
        stage(bare, docs, sf_dir)
        found = docs.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r.rows for r in found) == 3000 and max(r.size for r in found) < 6 << 20, name
