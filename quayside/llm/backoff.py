"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The count tables are partitioned by hash of the n-gram. Every batch of documents explodes its texts to n-grams,
folds equal ones and sends each hash with its count to the bucket that holds it. The bucket joins what it gets
with the sums over all batches and returns the sums. The batch looks its n-grams up in them and adds the
logarithms per document. This goes round once for every length. An n-gram is at most as frequent as its parts:
one with a part that the corpus has once occurs once itself and is not sent, nor is one with a part below the
required count. No n-gram is a hot key: it is sent once a batch, however frequent it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import blocks, mix, total_bytes, word_hashes
from quayside.llm.messages import MESSAGE, messages, pack, unpack

BATCH_BYTES = 12 << 20
#: Bits of a hash that are sent; the bucket, which the highest bits decide, adds to them.
SENT_BITS = 48


def words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and how many each has."""
    found = [word_hashes(b) for b in blocks(table["text"].combine_chunks())]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ngrams(hashes: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order`` the hash of the n words that end at each word; 0 where the text has fewer before it."""
    out = [mix(hashes)]
    for n in range(2, order + 1):
        longer = np.zeros(len(hashes), np.uint64)
        longer[1:] = mix(out[-1][:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:] + np.uint64(n))
        longer[place < n - 1] = 0
        out.append(longer)
    return out


class Text:
    """The n-grams of a batch's texts, and what is known of their counts so far."""

    def __init__(self, docs: pa.Table, order: int, buckets: int, least: int) -> None:
        hashes, self.sizes = words(docs)
        self.words, self.buckets, self.least = len(hashes), buckets, least
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.by_order = ngrams(hashes, place, order)
        self.counts: list[np.ndarray] = []

    def wanted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the sum of an n-gram of the next length does not follow from its parts; the different ones, their counts.

        Hash 0 stands for the number of words and is sent with the single words.
        """
        n = len(self.counts) + 1
        mask = self.by_order[n - 1] > 0
        if n > 1:
            often = self.counts[-1] >= max(self.least, 2)
            mask[1:] &= often[1:] & often[:-1]
        different, counts = np.unique(self.by_order[n - 1][mask], return_counts=True)
        if n == 1:
            different, counts = np.concatenate([[np.uint64(0)], different]), np.concatenate([[self.words], counts])
        return mask, different, counts

    def learn(self, table: pa.Table) -> None:
        """Take in the sums of the next length; n-grams that were not sent count 1, which is exact or below ``least``."""
        n = len(self.counts) + 1
        mask, different, _ = self.wanted()
        rows = sorted((b, f) for k, b, f in zip(*(table[c].to_pylist() for c in ("kind", "n", "f0")), strict=True) if k == n)
        sums = np.concatenate([np.zeros(0, np.int64), *(unpack(f).astype(np.int64) for _, f in rows)])
        if n == 1:
            self.all_words = int(sums[0])
        counts = (self.by_order[n - 1] > 0).astype(np.int64)
        counts[mask] = sums[np.searchsorted(different, self.by_order[n - 1][mask])]
        self.counts.append(counts)


def explode(batch: int, docs: pa.Table, table: pa.Table | None, n: int, buckets: int, least: int) -> pa.Table:
    """The n-grams of one length, to buckets that are ranges of the highest 24 bits of the hash."""
    text = Text(docs, n, buckets, least)
    for _ in range(n - 1):
        text.learn(table)
    _, different, counts = text.wanted()
    edges = np.searchsorted((different >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1))
    rows = []
    for bucket in np.flatnonzero(np.diff(edges)):
        part = slice(edges[bucket], edges[bucket + 1])
        own = different[part] & np.uint64((1 << SENT_BITS) - 1)
        # 32 low bits as they are; what is above rises within a bucket but for a jump, so steps are small
        above = np.diff((own >> np.uint64(32)).astype(np.int64), prepend=0)
        rows.append((int(bucket), n, batch, own.astype(np.uint32).tobytes(), pack(above & 0xFFFF), pack(counts[part])))
    return messages(rows)


def total(bucket: int, table: pa.Table) -> pa.Table:
    """The sums of the counts that the batches have sent, to each batch in the order of its hashes."""
    rows = table.to_pylist()
    low = np.concatenate([np.frombuffer(r["f0"], np.uint32) for r in rows])
    high = np.concatenate([unpack(r["f1"]).astype(np.int64).cumsum() & 0xFFFF for r in rows])
    counts = np.concatenate([unpack(r["f2"]).astype(np.int64) for r in rows])
    _, which = np.unique(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), return_inverse=True)
    sums = np.zeros(int(which.max()) + 1, np.int64)
    np.add.at(sums, which, counts)
    ends = np.cumsum([len(r["f0"]) // 4 for r in rows])
    return messages([(r["n"], r["kind"], bucket, pack(part)) for r, part in zip(rows, np.split(sums[which], ends[:-1]), strict=True)])


def word_scores(by_order: list[np.ndarray], counts: list[np.ndarray], all_words: int, least: int, backoff: float) -> np.ndarray:
    """The logarithm of each word's score, from the counts of the n-grams that end at it."""
    score = counts[0] / max(1, all_words)
    for n in range(2, len(by_order) + 1):
        exists = by_order[n - 1] > 0
        seen = exists & (counts[n - 1] >= least)
        before = np.concatenate([[1], counts[n - 2][:-1]])
        score = np.where(seen, counts[n - 1] / np.maximum(before, 1), np.where(exists, backoff * score, score))
    return np.log(score)


def score(docs: pa.Table, table: pa.Table, order: int, buckets: int, least: int, backoff: float) -> pa.Table:
    text = Text(docs, order, buckets, least)
    for _ in range(order):
        text.learn(table)
    sizes = text.sizes
    by_word = word_scores(text.by_order, text.counts, text.all_words, least, backoff)
    sums_by_word = np.bincount(np.repeat(np.arange(len(sizes)), sizes), by_word, len(sizes))
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "n_tokens": pa.array(sizes, pa.int64()),
            "score": pa.array(np.round(sums_by_word, 6) + 0.0, pa.float64()),
            "per_token": pa.array(np.round(sums_by_word / np.maximum(sizes, 1), 6) + 0.0, pa.float64(), mask=sizes == 0),
        }
    )


def scores(docs: DataFrame, order: int = 3, least: int = 1, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_tokens, score (sum of natural logarithms) and per_token, the mean, for every row.

    A word's score is the count of the longest n-gram that ends at it, up to ``order`` words, over the count of
    that n-gram without its last word; n-grams of two and more words that the corpus has fewer than ``least``
    times count as unseen, and every step down costs the factor ``backoff``. As the corpus holds the documents
    themselves, ``least=1`` knows every n-gram and steps down only where a text begins. Single words are taken over
    all words. Counts cover all rows, repeated ones as often as they occur. Null and texts without words have score
    0 and no mean. Both figures are rounded to 6 places.
    """
    batches = max(1, -(-total_bytes(docs, "text") // BATCH_BYTES))
    placed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_batch = placed.groupBy("batch")

    def longer(n: int):
        return lambda key, d, t: explode(key[0].as_py(), d, t, n, batches, least)

    known: DataFrame | None = None
    for n in range(1, order + 1):
        if known is None:
            sent = by_batch.applyInArrow(lambda key, d: explode(key[0].as_py(), d, None, 1, batches, least), MESSAGE)
        else:
            sent = by_batch.cogroup(known.groupBy("to")).applyInArrow(longer(n), MESSAGE)
        sums = sent.groupBy("to").applyInArrow(lambda key, t: total(key[0].as_py(), t), MESSAGE)
        known = sums if known is None else known.union(sums)
    return by_batch.cogroup(known.groupBy("to")).applyInArrow(
        lambda key, d, t: score(d, t, order, batches, least, backoff), "doc_id long, n_tokens long, score double, per_token double"
    )


ORACLE = r"""
WITH tokens AS (
  SELECT r, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents)
),
placed AS (
  SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS w1, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM tokens
),
c1 AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM placed WHERE w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM placed WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
scored AS (
  SELECT p.r,
    CASE WHEN p.w2 IS NOT NULL AND c3.n >= 1 THEN c3.n / h2.n
         ELSE CASE WHEN p.w2 IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END
            * CASE WHEN p.w1 IS NOT NULL AND c2.n >= 1 THEN c2.n / h1.n
                   ELSE CASE WHEN p.w1 IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END * (c1.n / (SELECT count(*) FROM placed)) END
    END AS s
  FROM placed p JOIN c1 ON c1.w = p.w
  LEFT JOIN c2 ON c2.w1 = p.w1 AND c2.w = p.w
  LEFT JOIN c3 ON c3.w2 = p.w2 AND c3.w1 = p.w1 AND c3.w = p.w
  LEFT JOIN c1 AS h1 ON h1.w = p.w1
  LEFT JOIN c2 AS h2 ON h2.w1 = p.w2 AND h2.w = p.w1
),
summed AS (SELECT r, count(*) AS n, sum(ln(s)) AS s FROM scored GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(s, 0), 6) AS score, round(s / n, 6) AS per_token
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN summed USING (r)
"""
