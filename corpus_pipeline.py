"""A cleaning pipeline over ``documents``: every stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import byte_bpe, decontaminate, minhash_forest, suffix_repeats, toxicity
from quayside.llm.queries import RANKS, table
from quayside.session import configure, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, does not reject."""
    logs, model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.predict(docs, logs, model, keep=COLUMNS[1:])
    return kept.where("predicted = 0").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id."""
    kept = minhash_forest.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def new_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that occurred before.

    A character of which bytes are gone goes as a whole; n_chars is counted anew. A null text stays null.
    """
    marked = docs.withColumn("was_null", F.col("text").isNull())
    left = suffix_repeats.without_repeats(marked, carry=("lang", "source", "was_null"), characters=True)
    text = F.when(~F.col("was_null"), F.col("kept"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of what is left."""
    return byte_bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)


def configured(stage: Stage) -> Stage:
    """The stage under the settings that the operators are written for, also where it is called by itself."""
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", configured(not_toxic)),
    ("minhash_forest", configured(one_of_near_copies)),
    ("suffix_repeats", configured(new_text)),
    ("decontaminate", configured(without_benchmarks)),
    ("byte_bpe", configured(tokens)),
]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
