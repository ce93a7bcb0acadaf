"""Benchmark items that training texts contain.

An inverted index of the test items holds BM25 weights, divided by the score an item has against itself, so
that one threshold fits all items. Every passage of every text is a query: two neighbouring segments of its
words, which are as long as the items looked for. Items are indexed in blocks with the largest weight of each term in a block. As in block-max WAND, the
maxima of a passage's terms bound what any item of a block can reach, and blocks below the threshold are skipped;
the items of the others are scored in full. Where an item reaches the threshold, its question and its answer
have to be found in the passage. Bounds and scores are computed for many passages at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import LETTER_BYTE, Block, blocks, handed_back, mix, record_batch, stored, total_bytes, with_rows, word_hashes


#: Bounds of (segment, block), and entries of postings, that are held at a time.
BOUND_CELLS = 1 << 21


@dataclass(frozen=True)
class Settings:
    """``threshold``: share of an item's own BM25 score a passage has to reach. ``overlap``: share of the runs of
    ``run`` words of question and answer each that the passage has to contain. ``part``: bytes of items indexed at
    a time, the bound of what is broadcast; more items take more passes.
    """

    threshold: float = 0.6
    overlap: float = 0.5
    run: int = 3
    k1: float = 1.2
    b: float = 0.75
    items_in_block: int = 8
    part: int = 8 << 20


def lower_blocks(column: pa.Array) -> Iterator[Block]:
    yield from blocks(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def words_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in lower_blocks(pa.array(texts, pa.large_string())):
        hashes, sizes = word_hashes(block, LETTER_BYTE)
        out += np.split(hashes, np.cumsum(sizes)[:-1])
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; one sentence is both."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if re.search(r"\w", s)]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return out


@dataclass
class Index:
    """Postings by term: items with weights, and blocks with the largest weight of their items."""

    item_ids: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray
    slots: np.ndarray
    posting_at: np.ndarray
    posting_item: np.ndarray
    posting_weight: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_weight: np.ndarray
    blocks: int
    segment: int
    settings: Settings

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms, -1 for others. A table of slots rules most words out before the search."""
        out = np.full(len(hashes), -1)
        likely = np.flatnonzero(self.slots[hashes & np.uint64(len(self.slots) - 1)])
        at = np.minimum(np.searchsorted(self.terms, hashes[likely]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[likely]
        out[likely[hit]] = at[hit]
        return out


def segment_of(words: int, longest: int) -> int:
    """Words in a segment for an item of so many words: wherever a copy starts, it ends in the next segment at the latest.

    Items of up to 1024 words share one size, that of the ``longest`` of all items; longer ones have the next power of two.
    """
    usual = int(np.clip(longest, 32, 1024))
    return usual if words <= usual else 1 << (words - 1).bit_length()


def build(items: list[tuple[int, str]], frequency: dict[int, int], count: int, mean_length: float, segment: int, settings: Settings) -> Index | None:
    """``frequency`` of each term, ``count`` and ``mean_length`` are those of all items, indexed here or not."""
    split = [question_and_answer(text) for _, text in items]
    whole, question, answer = (words_of(list(t)) for t in ([t for _, t in items], [q for q, _ in split], [a for _, a in split]))
    triples = []
    for i, words in enumerate(whole):
        term, tf = np.unique(words, return_counts=True)
        idf = np.log(1 + np.array([(count - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5) for t in term]))
        weight = idf * tf * (settings.k1 + 1) / (tf + settings.k1 * (1 - settings.b + settings.b * len(words) / mean_length))
        if len(term):
            triples.append((term, np.full(len(term), i), weight / weight.sum()))
    if not triples:
        return None
    term, item, weight = (np.concatenate(x) for x in zip(*triples, strict=True))
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    terms, at = np.unique(term, return_index=True)
    key, where = np.unique(np.stack([np.searchsorted(terms, term), item // settings.items_in_block]), axis=1, return_inverse=True)
    top = np.zeros(key.shape[1])
    np.maximum.at(top, where.ravel(), weight)
    slots = np.zeros(1 << max(16, int(len(terms) * 16).bit_length()), bool)
    slots[terms & np.uint64(len(slots) - 1)] = True
    return Index(
        [i for i, _ in items], list(zip(question, answer, strict=True)), terms, slots, np.append(at, len(term)), item, weight,
        np.searchsorted(key[0], np.arange(len(terms) + 1)), key[1], top, len(items) // settings.items_in_block + 1,
        segment, settings,
    )


def expanded(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of each of the terms, and to which of the terms each belongs."""
    count = at[term + 1] - at[term]
    owner = np.repeat(np.arange(len(term)), count)
    return np.repeat(at[term] - np.cumsum(count) + count, count) + np.arange(len(owner)), owner


def possible(index: Index, segment: np.ndarray, term: np.ndarray, segments: int, same: np.ndarray) -> np.ndarray:
    """Pairs (segment, block) whose bound, of the segment and the next one of its text, reaches the threshold.

    ``segment`` ascends. Bounds are computed for a slice of segments at a time, so that a text of any length and any
    number of items take bounded memory; the segment after a slice is read with it.
    """
    postings = np.append(0, np.cumsum(np.diff(index.block_at)[term]))
    found, first = [np.zeros((0, 2), np.int64)], 0
    while first < segments:
        begin = int(np.searchsorted(segment, first))
        full = int(np.searchsorted(postings, postings[begin] + BOUND_CELLS, "right")) - 1
        last = int(segment[full]) if full < len(segment) else segments
        last = max(first + 1, min(last, first + BOUND_CELLS // index.blocks, segments))
        upto = min(segments, last + 1)
        end = int(np.searchsorted(segment, upto))
        place, owner = expanded(index.block_at, term[begin:end])
        cell = (segment[begin:end][owner] - first) * index.blocks + index.block[place]
        bound = np.bincount(cell, index.block_weight[place], (upto - first) * index.blocks).reshape(-1, index.blocks)
        bound[:-1] += np.where(same[first : upto - 1, None], bound[1:], 0)
        found.append(np.argwhere(bound[: last - first] >= index.settings.threshold - 1e-9) + [first, 0])
        first = last
    return np.concatenate(found)


def scored(index: Index, block: Block) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, overlap of the question, of the answer) for all verified passages of a block of texts."""
    hashes, sizes = word_hashes(block, LETTER_BYTE)
    if not len(hashes):
        return
    settings, size = index.settings, index.segment
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(place % size == 0)
    segment = np.cumsum(place % size == 0) - 1
    term = index.lookup(hashes)
    known = term >= 0
    pair = np.unique(segment[known] * len(index.terms) + term[known])
    of_segment, of_term = pair // len(index.terms), pair % len(index.terms)
    row_of = row[start]
    found = possible(index, of_segment, of_term, len(start), row_of[1:] == row_of[:-1])
    ends = np.append(start, len(hashes))
    segments, begins = np.unique(found[:, 0], return_index=True)
    for s, begin, end in zip(segments, begins, np.append(begins, len(found))[1:], strict=True):
        last = s + 1 if s + 1 < len(start) and row_of[s + 1] == row_of[s] else s
        terms = np.unique(of_term[np.searchsorted(of_segment, s) : np.searchsorted(of_segment, last, "right")])
        at, owner = expanded(index.posting_at, terms)
        allowed = np.isin(index.posting_item[at] // settings.items_in_block, found[begin:end, 1])
        score = np.bincount(index.posting_item[at[allowed]], index.posting_weight[at[allowed]])
        words = hashes[ends[s] : ends[last + 1]]
        for item in np.flatnonzero(score >= settings.threshold - 1e-9):
            shares = []
            for part in index.parts[item]:
                n = min(settings.run, len(part))
                wanted = np.unique(runs(part, n)) if n else np.zeros(0, np.uint64)
                shares.append(float(np.isin(wanted, runs(words, n)).mean()) if len(wanted) else 1.0)
            if min(shares) >= settings.overlap:
                yield int(row_of[s]), int(item), float(score[item]), shares[0], shares[1]


def indexes(items: DataFrame, settings: Settings) -> Iterator[Index]:
    """Indexes of all items, a part of bounded size at a time, items of one size of segment in each.

    Statistics are those of all items together.
    """
    own = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = max(1, -(-2 * total_bytes(own, "text") // settings.part))
    own = own.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("term", pa.int64()), ("n", pa.int64())])
        for batch in with_rows(batches):
            for part, words in zip(batch.column(0).to_pylist(), words_of(batch.column(1).to_pylist()), strict=True):
                term = np.unique(words).view(np.int64)
                yield record_batch({"part": [part] * (len(term) + 1), "term": [None, *term], "n": [len(words), *[1] * len(term)]}, schema)

    seen = stored(own.select("part", "text").mapInArrow(count, "part long, term long, n long"), "item-terms")
    sums = stored(seen.groupBy("term").agg(F.sum("n").alias("n")), "item-frequencies")
    length, number = seen.where("term IS NULL").agg(F.sum("n").alias("n"), F.max("n").alias("longest")).first(), own.count()
    for part in range(parts if number else 0):
        terms = seen.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
        frequency = {r.term & 0xFFFFFFFFFFFFFFFF: r.n for r in terms.join(sums, "term").collect()}
        rows = [(r.item_id, r.text) for r in own.where(F.col("part") == part).orderBy("item_id", "text").collect()]
        by_segment: dict[int, list[tuple[int, str]]] = {}
        for row, words in zip(rows, words_of([text for _, text in rows]), strict=True):
            by_segment.setdefault(segment_of(len(words), length.longest), []).append(row)
        for segment, own_rows in sorted(by_segment.items()):
            index = build(own_rows, frequency, number, max(1.0, length.n / number), segment, settings)
            if index:
                yield index


def matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, question and answer: items found in each document, with the best passage's figures.

    Passages cover every whole text, and two of an item's segments hold a copy of it, however long it is. Null and empty texts contain nothing, items without words are never found.
    Repeated rows, and rows of one doc_id, are reported together; rows with null doc_id too. Items of one
    item_id are found if any of their texts is. Other columns than doc_id, item_id and text are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])
    result = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question double, answer double")
    for index in indexes(items, settings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in with_rows(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for block in lower_blocks(batch.column(1)):
                    rows += [(ids[block.first + r], sent.value.item_ids[i], *rest) for r, i, *rest in scored(sent.value, block)]
                if rows:
                    yield record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

        result = result.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, result.schema))
    best = F.max(F.struct("score", "question", "answer"))
    return result.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows whose text contains no item, with all their columns; no exchange, and one Python process a task for all indexes."""
    context = docs.sparkSession.sparkContext
    all_sent = [context.broadcast(index) for index in indexes(items, settings)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            for sent in all_sent:
                clean = np.ones(batch.num_rows, bool)
                for block in lower_blocks(batch.column(batch.schema.names.index("text"))):
                    for row, *_ in scored(sent.value, block):
                        clean[block.first + row] = False
                batch = batch.filter(pa.array(clean))
            yield batch

    return docs.mapInArrow(lambda batches: handed_back(run(batches)), docs.schema) if all_sent else docs
