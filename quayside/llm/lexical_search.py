"""Ranked lexical search: the best documents for each benchmark item, with documents folded to bags.

A document is restricted to the terms of all items. Documents with the same term counts and the same length
term ``m`` score alike for every item, so they form a class: grouped by hash, told apart by the whole vector.
Each class is scored once; its members are expanded by ascending doc_id at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.blocks import blocks, record_batch, stored, with_rows, word_hashes

#: Bytes of a term: ASCII letters and digits, and everything beyond ASCII.
TERM_BYTE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Stands for every doc_id that is null; it comes after all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    """``best``: results an item. ``table_bytes``: up to so many bytes the vocabulary (16 a term) is sent to the tasks; a
    larger one is joined. ``item_terms``: so many terms of items are scored in one pass over the classes. ``cells``:
    classes times terms that a task unfolds at a time.
    """

    best: int = 10
    table_bytes: int = 32 << 20
    item_terms: int = 2_000_000
    cells: int = 2_000_000


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and number of rows of a block, the terms of each row, and (row, term, count) of all of it as three arrays in order."""
    for block in blocks(column):
        hashes, sizes = word_hashes(block, TERM_BYTE)
        row = np.repeat(np.arange(block.rows), sizes)
        yield block.first, sizes, *_folded(row, hashes.view(np.int64))


def _folded(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(np.append(at, len(row)))


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


_BAG = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
BAG = "id long, n long, terms array<long>, counts array<long>"


def bags(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """id, n (terms with repeats), and the different terms, as ascending 64-bit hashes, with their counts; rows without terms go.

    ``rows``: id, text. ``only``: ascending terms that are kept; the others still count in n.
    """
    sent = None if only is None else rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            for first, sizes, row, term, count in _counts(batch.column(1)):
                if sent is not None:
                    known = sent.value
                    at = np.searchsorted(known, term)
                    at[at == len(known)] = 0
                    fits = known[at] == term if len(known) else np.zeros(len(term), bool)
                    row, term, count = row[fits], term[fits], count[fits]
                ids = batch.column(0).slice(first, len(sizes))
                whole = record_batch({"id": ids, "n": sizes, "terms": _lists(row, term, len(sizes)), "counts": _lists(row, count, len(sizes))}, _BAG)
                yield whole.filter(pa.array(sizes > 0))

    return rows.select("id", "text").mapInArrow(run, BAG)


def _restricted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Bags restricted to a vocabulary of any size, by a join on the terms."""
    whole = stored(bags(docs).withColumn("row", F.monotonically_increasing_id()), "bags")
    each = whole.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    # a row has each term once, so a row's group has as many rows as the document has terms
    own = each.join(vocabulary, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("term", "count"))).alias("t"))
    none = F.array().cast("array<long>")
    return whole.select("row", "id", "n").join(own, "row", "left").select(
        "id", "n", F.coalesce(F.col("t.term"), none).alias("terms"), F.coalesce(F.col("t.count"), none).alias("counts")
    )


def weight(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def bag_classes(restricted: DataFrame, documents: int, length: int, best: int) -> DataFrame:
    """m, terms, counts and the ``best`` smallest ids of every class of equal bags that holds a term at all.

    The rank is limited before the exchange too: a task sends ``best`` ids of a class at most, however many copies it has.
    """
    # 90 * n * N may pass 64 bits
    m = (F.lit(10) + F.expr(f"cast((cast(90 * n as decimal(20,0)) * cast({documents} as decimal(18,0))) div cast({max(1, length)} as decimal(20,0)) as long)")).alias("m")
    rows = restricted.where(F.size("terms") > 0).select("id", m, "terms", "counts")
    keyed = rows.withColumn("hash", F.xxhash64("m", "terms", "counts"))
    # the hash deals out the rows, the vectors themselves are compared
    alike = Window.partitionBy("hash", "m", "terms", "counts").orderBy("id")
    few = keyed.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= best)
    return few.groupBy("hash", "m", "terms", "counts").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("m", "terms", "counts", "ids")


class Items:
    """The different terms of some items: ids, which terms each has, and the weight of every term."""

    def __init__(self, ids: list, bags: list[np.ndarray], terms: np.ndarray, weights: np.ndarray) -> None:
        self.ids, self.terms, self.weights = ids, terms, weights
        self.bags = [np.searchsorted(terms, bag) for bag in bags]


def _best(scores: np.ndarray, ids: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` highest scores above 0, equal ones by ascending id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > best:
        limit = np.partition(scores[at], len(at) - best)[len(at) - best]
        at = at[scores[at] >= limit]
    return at[np.lexsort((ids[at], -scores[at]))][:best]


def scored_classes(classes: DataFrame, items: Items, search: Search) -> DataFrame:
    """item, score, ids: for each task and item the ``best`` classes by score, then by their smallest id.

    No document of a class behind ``best`` others can be among an item's ``best`` documents.
    """
    sent = classes.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = sent.value, search.best
        held: list[list[tuple[int, int, list[int]]]] = [[] for _ in own.ids]
        for batch in with_rows(batches):
            at = 0
            width = max(1, len(own.terms))
            while at < batch.num_rows:
                part = batch.slice(at, max(1, search.cells // width))
                at += part.num_rows
                lists, counts, m = part.column(1), part.column(2), part.column(0).to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), size)
                term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
                place = np.searchsorted(own.terms, term)
                place[place == len(own.terms)] = 0
                fits = own.terms[place] == term
                row, place, tf = row[fits], place[fits], tf[fits]
                # a row for each term that occurs here, and one of zeros for all others
                active, line = np.unique(place, return_inverse=True)
                table = np.zeros((len(active) + 1, part.num_rows), np.int64)
                table[line, row] = own.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                line_of = np.full(len(own.terms), len(active))
                line_of[active] = np.arange(len(active))
                ids = part.column(3)
                smallest = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                for i, bag in enumerate(own.bags):
                    lines = line_of[bag]
                    scores = table[lines[lines < len(active)]].sum(axis=0)
                    # what cannot come into the list held is left out at once
                    if len(held[i]) == best:
                        scores[scores < held[i][-1][0]] = 0
                    found = _best(scores, smallest, best)
                    if len(found):
                        new = [(int(scores[j]), int(smallest[j]), ids[int(j)].as_py()) for j in found]
                        held[i] = sorted(held[i] + new, key=lambda x: (-x[0], x[1]))[:best]
        rows = [(own.ids[i], score, members) for i, some in enumerate(held) for score, _, members in some]
        if rows:
            yield record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return classes.select("m", "terms", "counts", "ids").mapInArrow(run, "item long, score long, ids array<long>")


def _portions(items: DataFrame, limit: int) -> Iterator[DataFrame]:
    """Items in portions of about ``limit`` terms, dealt by a hash of their rows."""
    total = int(items.agg(F.sum(F.size("terms"))).first()[0] or 0)
    parts = max(1, -(-total // limit))
    for part in range(parts if total else 0):
        yield items.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)


def ranked(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id and score: for each item its ``search.best`` documents with a score above 0, equal scores by doc_id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; two are equal if their 64-bit
    hashes are. Every row of ``docs`` is a document, also with a repeated doc_id; null ids come last, as null. Every row
    of ``benchmark`` is an item, rows with one item_id (or null) are each ranked by themselves. Null texts have no
    terms, and items or documents without terms no results. Statistics cover all documents. Other columns than doc_id,
    item_id and text are not looked at.

    Items, and the counts of their terms, reach the tasks in portions of ``search.item_terms``; each portion is
    one pass over the classes, not over the texts.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    asked = stored(bags(benchmark.select(F.col("item_id").cast("long").alias("id"), "text")).withColumn("row", F.monotonically_increasing_id()), "items")
    vocabulary = stored(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    if 16 * vocabulary.count() <= search.table_bytes:
        known = np.sort(vocabulary.toPandas()["term"].to_numpy(np.int64))
        restricted = bags(texts, known)
    else:
        restricted = _restricted(texts, vocabulary)
    restricted = stored(restricted, "restricted-bags")
    documents, length = restricted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = stored(restricted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    classes = stored(bag_classes(restricted, documents, length, search.best), "bag-classes")
    found = None
    for portion in _portions(asked, search.item_terms):
        rows = portion.select("row", "terms").toPandas().sort_values("row")
        terms = portion.select(F.explode("terms").alias("term")).distinct()
        counted = terms.join(df, "term").toPandas().sort_values("term")
        term, n = (counted[c].to_numpy(np.int64) for c in ("term", "df"))
        own = Items(rows["row"].tolist(), [np.intersect1d(np.array(t, np.int64), term) for t in rows["terms"]], term, weight(documents, n))
        some = scored_classes(classes, own, search)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    members = found.select("item", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    top = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.best)
    doc_id: Column = F.nullif("id", F.lit(NO_ID))
    named = asked.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return top.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT AS d, sum(n)::BIGINT AS l FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(d) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, corpus GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * d) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
