"""Language identification with language-bitmask n-gram filters.

Each language has the set of byte n-grams that are typical for it. All sets live in one Bloom filter
whose slots are bit masks, one bit a language: two probes and an AND give all languages that contain an
n-gram. A text's n-grams are looked up, the bits are counted per language, the counts are corrected for
the false positives each language's fill lets through, and the largest corrected count decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.blocks import Block, blocks, fold_of, mix, record_batch, stored, with_rows

UNKNOWN = "und"
#: Rows of a language that are drawn at least, if it has them.
LEAST_ROWS = 50


@dataclass(frozen=True)
class Settings:
    """``sample``: about so many labelled documents, chosen by hash, are learned from, of every language some.
    ``grams``: the most frequent n-grams kept per language. ``least``: an n-gram seen less often is left out.
    ``typical``: an n-gram belongs to a language if its frequency there is this share of its highest one.
    """

    sample: int = 40_000
    grams: int = 100_000
    least: int = 3
    typical: float = 0.2
    size: int = 4


@dataclass(frozen=True)
class Filter:
    """``slots``: one row of masks for every 64 languages. ``passes``: share of random n-grams a language lets through."""

    languages: tuple[str, ...]
    slots: np.ndarray
    passes: np.ndarray
    size: int


def _letters_kept() -> np.ndarray:
    """Lower-cased text keeps its letters; every other ASCII byte becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        if not chr(byte).isalpha():
            table[byte] = 32
    return table


_KEPT = _letters_kept()


def padded_blocks(texts: pa.Array) -> Iterator[Block]:
    """Blocks of lower-cased texts with spaces around them, so that short words have n-grams too."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    edge = pa.scalar("  ", pa.large_string())
    yield from blocks(pc.binary_join_element_wise(edge, lower, edge, pa.scalar("", pa.large_string())))


def grams_of(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of up to 8 bytes as integers, and the row of each; those with two spaces in a row are left out."""
    data = _KEPT[block.data]
    count = max(0, len(data) - size + 1)
    grams = np.zeros(count, np.uint64 if size > 4 else np.uint32)
    useful = np.ones(count, bool)
    space = data == 32
    for i in range(size):
        grams <<= grams.dtype.type(8)
        grams |= data[i : i + count]
        if i:
            useful &= ~(space[i - 1 : i - 1 + count] & space[i : i + count])
    at = np.flatnonzero(useful)
    row = block.row_of_bytes()
    at = at[row[at] == row[at + size - 1]]
    return grams[at], row[at]


def _places(grams: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    hashed = mix(grams)
    last = np.uint64(slots - 1)
    return (hashed & last).astype(np.int64), ((hashed >> np.uint64(32)) & last).astype(np.int64)


def rows_a_language(counts: list[int], sample: int) -> float:
    """The most rows of one language if all languages together have ``sample``: small ones whole, large ones alike.

    No fewer than ``LEAST_ROWS``, so that a hash cut leaves some rows of every language.
    """
    left, most = float(sample), math.inf
    for i, n in enumerate(sorted(counts)):
        if n > left / (len(counts) - i):
            most = left / (len(counts) - i)
            break
        left -= n
    return max(LEAST_ROWS, most)


def learn(docs: DataFrame, labelled, settings: Settings = Settings()) -> Filter:
    """Learn from the rows where ``labelled`` holds and lang is not null; whole texts, in any order of rows.

    Only counts by language and n-gram are exchanged. What comes to the driver are at most
    ``settings.grams`` n-grams a language. No labelled rows give a filter without languages.
    """
    chosen = docs.select("doc_id", "lang", "text").where(labelled & F.col("lang").isNotNull())
    rows = {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()}
    most = rows_a_language(list(rows.values()), settings.sample)
    cuts = [(lang, int(2**62 * most / n)) for lang, n in rows.items() if n > most]
    if cuts:
        of_language = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
        drawn = F.col("cut").isNull() | (F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.col("cut"))
        chosen = chosen.join(of_language, "lang", "left").where(drawn).select("doc_id", "lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for batch in with_rows(batches):
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang)).column(1)
                for block in padded_blocks(own):
                    gram, n = np.unique(grams_of(block, settings.size)[0], return_counts=True)
                    yield record_batch({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram.astype(np.int64), "n": n}, schema)

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = Window.partitionBy("gram")
    counted = stored(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))  # no more rows than the sample has
    typical = (
        counted.where(F.col("n") >= settings.least)
        .join(F.broadcast(totals), "lang")
        .withColumn("share", F.col("n") / F.col("all"))
        .withColumn("top", F.max("share").over(by_gram))
        .where(F.col("share") >= settings.typical * F.col("top"))
    )
    typical = stored(typical.select("lang", "gram", "n"), "typical-grams")
    sizes = {r.lang: r["count"] for r in typical.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    slots = 1 << max(10, (16 * max([1, *(min(n, settings.grams) for n in sizes.values())])).bit_length())
    masks = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
    for i, lang in enumerate(languages):
        own = typical.where(F.col("lang") == lang).select("gram", "n")
        if sizes[lang] > settings.grams:
            own = own.orderBy(F.desc("n"), "gram").limit(settings.grams)
        grams = own.select("gram").toPandas()["gram"].to_numpy(np.uint64)
        for place in _places(grams, slots):
            masks[i // 64, place] |= np.uint64(1 << i % 64)
    fill = np.array([np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return Filter(languages, masks, fill**2, settings.size)


def corrected_counts(block: Block, model: Filter) -> np.ndarray:
    """Rows by languages: n-grams that are really in each language's set, by estimate; never below 0."""
    grams, row = grams_of(block, model.size)
    first, second = _places(grams, model.slots.shape[1])
    ends = np.searchsorted(row, np.arange(block.rows + 1))
    every = np.diff(ends)
    counts = np.zeros((block.rows, len(model.languages)))
    for word in range(model.slots.shape[0]):
        masks = model.slots[word][first] & model.slots[word][second]
        one = masks.dtype.type(1)
        for i in range(64 * word, min(64 * word + 64, len(model.languages))):
            seen = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(i % 64)) & one, dtype=np.int64)])
            counts[:, i] = np.diff(seen[ends])
    return np.maximum(0, (counts - every[:, None] * model.passes) / np.maximum(1e-9, 1 - model.passes))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; no exchange.

    Null texts, texts without a letter, and all texts if there is no learned language, are ``und`` with
    score 0. Equal counts go to the language first in order. The score is the winner's share of the two largest counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        own = sent.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in with_rows(batches):
            has = np.asarray(batch.column(2).fill_null(False), dtype=bool)
            best = np.full(batch.num_rows, len(own.languages))
            score = np.zeros(batch.num_rows)
            if own.languages:
                for block in padded_blocks(batch.column(1)):
                    counts = corrected_counts(block, own)
                    rows = slice(block.first, block.first + block.rows)
                    best[rows] = counts.argmax(1)
                    top = np.sort(np.pad(counts, ((0, 0), (1, 0))), axis=1)[:, -2:]
                    score[rows] = top[:, 1] / np.maximum(1e-9, top.sum(1))
            best[~has], score[~has] = len(own.languages), 0
            yield record_batch({"doc_id": batch.column(0), "lang_pred": names[best], "score": score}, schema)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col("doc_id").cast("long"), "text", letters).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod 4 is not 2, then predict every document."""
    learned = F.coalesce(fold_of("doc_id", 4) != 2, F.lit(False))
    model = learn(docs, learned, settings)
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
