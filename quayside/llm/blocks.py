"""Text columns as runs of UTF-8 bytes for numpy work inside tasks, and small shared helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.session import scratch

#: Bytes of text handled at a time inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Block:
    """Rows ``first`` to ``first + len(starts) - 1`` of a batch: all their bytes and where each text starts and ends."""

    first: int
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts)

    def row_of_bytes(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int32), self.ends - self.starts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, whole


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows whose texts have ``limit`` bytes together, one row at least."""
    offsets, whole = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        yield Block(first, at[:-1], at[1:], whole[offsets[first] : offsets[last]])
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= _MIX_1
    values ^= values >> np.uint64(27)
    values *= _MIX_2
    values ^= values >> np.uint64(31)
    return values


_rng = np.random.default_rng(20240101)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_POWER = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.full(BLOCK_BYTES, np.uint64(_POWER)))
_INVERSES = np.multiply.accumulate(np.full(BLOCK_BYTES, np.uint64(pow(_POWER, -1, 1 << 64))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2**64, and their inverses."""
    if n <= BLOCK_BYTES:
        return _POWERS[:n], _INVERSES[:n]
    return tuple(np.multiply.accumulate(np.full(n, x[0])) for x in (_POWERS, _INVERSES))


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_VALUES = BYTE_VALUES[_LOWER]


#: Letters and digits, and all bytes of other alphabets.
LETTER_BYTE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def word_hashes(block: Block, word_byte: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, in order, and how many each row has.

    Words are runs of bytes that ``word_byte`` marks: all but ASCII white space unless said otherwise.
    """
    data = block.data
    inside = word_byte[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = block.starts[block.ends > block.starts]
    first[filled] = inside[filled]
    last[filled[1:] - 1] = inside[filled[1:] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WORD_VALUES[data] * power, out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([block.starts, block.ends[-1:]]))
    return hashes, np.diff(bounds)


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[field.name], field.type) for field in schema], schema=schema)


def handed_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then what pyarrow keeps for later goes back to the system, as the worker lives on and serves other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def with_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch for batch in batches if batch.num_rows)


def fold_of(doc_id: str, folds: int):
    """The remainder of crc32 of the id as text; null ids have none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one pass that sizes the number of partitions."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


#: Ids for each word of 64 bits in ``possibly``, and words at most: what is broadcast does not grow beyond.
IDS_A_WORD, MOST_WORDS = 8, 1 << 18


def possibly(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key is among ``ids``, and some others: about one in eight, more of them beyond 2 million ids.

    No exchange of ``df``: every id sets one bit of a word, and the words are broadcast.
    """
    words = min(MOST_WORDS, max(1, ids.count() // IDS_A_WORD))
    place = {"_word": F.pmod(F.xxhash64(key), F.lit(words)), "_bit": F.expr(f"shiftleft(1L, pmod(hash({key}), 64))")}
    marks = ids.select(*(c.alias(n) for n, c in place.items())).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = df.withColumns(place).join(F.broadcast(marks), "_word")
    return found.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*df.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as Parquet in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
