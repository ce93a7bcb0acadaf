"""Packing of documents into token windows by sum of squares.

A task keeps, for every fill level, how many partially filled windows stand at it. A document goes to the level
(or into a new window) that leaves the least sum of these counts squared. What is longer than a window fills
windows of its own first. Windows that are still open at the end of a task are completed by cutting documents;
the very last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import BLOCK_BYTES, BYTE_VALUES, Block, blocks, mix, powers, record_batch, with_rows

#: A tokenizer file larger than this is refused: it is sent to every executor.
MOST_TOKENIZER_BYTES = 64 << 20
#: Words that a worker remembers, some 30 bytes each; beyond that it starts anew.
MOST_WORDS = 3_000_000
#: Words encoded in one text.
JOINED = 256
#: Rows handed on at a time.
ROWS_OUT = 4096

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: Bytes that begin a character which may be white space beyond ASCII.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@dataclass(frozen=True)
class Packing:
    """Windows of ``window`` tokens; ``last`` is the id that ends every document.

    A task holds ``most_open`` unfinished windows at most. When they are that many, the next document is cut
    to complete the fullest of them, so no document waits for a fitting one.
    """

    window: int = 2048
    last: int = 1
    most_open: int = 8192


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        content = file.read(MOST_TOKENIZER_BYTES + 1)
    if len(content) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MOST_TOKENIZER_BYTES} characters")
    return content


def _after_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes that may begin a character other than white space; not sure ones are not marked."""
    return _PLAIN[data] | (data >= 0xC3) & ~_MAY_BE_SPACE[data]


def _before_space(data: np.ndarray) -> np.ndarray:
    """Marks bytes that end a character other than white space; not sure ones are not marked."""
    doubt = _MAY_BE_SPACE[data]
    near = np.zeros(len(data), bool)
    for step in (1, 2):
        near[step:] |= doubt[:-step]
    return _PLAIN[data] | (data >= 0x80) & (data < 0xC0) & ~near


class Words:
    """Ids of texts, by a tokenizer that sees most words once.

    A byte-level tokenizer with the usual pattern always splits a text before a blank between two characters other
    than white space. So the parts between such blanks are encoded by themselves, and remembered under a 64-bit
    hash. Other tokenizers get whole texts.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer)
        form = json.loads(tokenizer)
        split = form.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = {t["id"]: t for t in form.get("added_tokens", [])}
        apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in added.values())
        self.by_words = bool(usual and apart and form.get("normalizer") is None and form["model"]["type"] == "BPE")
        # bytes that a token stands for: a character of its name is a byte, but in added tokens
        names = {i: t for t, i in form["model"].get("vocab", {}).items()} if self.by_words else {}
        self._widths = np.zeros(max([*names, *added, 0]) + 1, np.int64)
        for i, name in names.items():
            self._widths[i] = len(name)
        for i, token in added.items():
            self._widths[i] = len(token["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._starts, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids of every text of a column, in order; null counts as empty."""
        for block in blocks(column):
            if not self.by_words:
                texts = [block.data[a:b].tobytes().decode() for a, b in zip(block.starts, block.ends, strict=True)]
                for i, e in enumerate(self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    yield block.first + i, np.array(e.ids, np.uint32)
                continue
            starts = self._word_starts(block)
            parts, sizes, stops = [], [], np.append(starts[1:], len(block.data))
            first = 0
            while first < len(starts):
                last = max(first + 1, int(np.searchsorted(stops, starts[first] + BLOCK_BYTES, "right")))
                ids, own = self._ids_of(block.data[starts[first] : stops[last - 1]], starts[first:last] - starts[first])
                parts.append(ids)
                sizes.append(own)
                first = last
            ids = np.concatenate([np.zeros(0, np.uint32), *parts])
            ends = np.concatenate([[0], *sizes]).cumsum().astype(np.int64)
            bounds = ends[np.searchsorted(starts, np.append(block.starts, len(block.data)))]
            for i in range(block.rows):
                yield block.first + i, ids[bounds[i] : bounds[i + 1]]

    @staticmethod
    def _word_starts(block: Block) -> np.ndarray:
        data = block.data
        cut = data == 0x20
        cut[1:] &= _before_space(data)[:-1]
        cut[:-1] &= _after_space(data)[1:]
        cut[-1:] = False
        filled = block.starts[block.ends > block.starts]
        cut[filled] = True
        cut[block.ends[block.ends > block.starts] - 1] &= block.ends[block.ends > block.starts] - 1 == filled
        return np.flatnonzero(cut)

    def _ids_of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of consecutive words that fill ``data``, and how many each word has."""
        stops = np.append(starts[1:], len(data))
        power, inverse = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * power, out=sums[1:])
        hashes, at, word = np.unique(mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)), return_index=True, return_inverse=True)
        place = np.searchsorted(self._hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self._hashes)
        known[inside] = self._hashes[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        made_at, made_size, made = self._made(data, starts[at[new]], stops[at[new]])
        where, size = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        where[known], size[known] = self._starts[place[known]], self._sizes[place[known]]
        where[new], size[new] = made_at + len(self._ids), made_size
        table = np.concatenate([self._ids, made])
        sizes = size[word]
        ends = np.cumsum(sizes)
        ids = table[np.repeat(where[word] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if len(new):
            self._ids = table
            self._hashes, self._starts, self._sizes = (
                np.insert(old, place[new], own[new]) for old, own in ((self._hashes, hashes), (self._starts, where), (self._sizes, size))
            )
            if len(self._hashes) > MOST_WORDS or len(self._ids) > 4 * MOST_WORDS:
                self._forget()
        return ids, sizes

    def _made(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word start, how many they are, and all of them."""
        words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        # such words may stand one after the other in one text; the bytes of the tokens tell where each ends
        joins = (data[starts] == 0x20) & _before_space(data)[stops - 1] & (stops - starts > 1) if len(words) else np.zeros(0, bool)
        joins[joins] = _after_space(data)[starts[joins] + 1]
        alone, together = np.flatnonzero(~joins), np.flatnonzero(joins)
        texts = [words[i].decode() for i in alone.tolist()]
        found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.zeros(len(words), np.int64)
        sizes[alone] = [len(ids) for ids in found]
        for at in range(0, len(together), JOINED):
            some = together[at : at + JOINED]
            text = b"".join([words[i] for i in some.tolist()]).decode()
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self._widths[ids]), np.cumsum(stops[some] - starts[some])) + 1
            sizes[some] = np.diff(ends, prepend=0)
            found.append(ids)
        order = np.concatenate([alone, together])
        where = np.empty(len(words), np.int64)
        where[order] = np.cumsum(sizes[order]) - sizes[order]
        return where, sizes, np.concatenate([np.zeros(0, np.uint32), *found])


@lru_cache(1)
def words(tokenizer: str) -> Words:
    return Words(tokenizer)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens),
        )


class Packer:
    """Online packing; finished windows are taken from ``done``."""

    def __init__(self, packing: Packing) -> None:
        self.size, self.most_open = packing.window, packing.most_open
        self.counts = np.zeros(self.size + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(self.size + 1)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.size:
            head, piece = piece.cut(self.size)
            self.done.append([head])
        if self.open >= self.most_open and len(piece):
            level = int(np.flatnonzero(self.counts)[-1])
            if len(piece) > self.size - level:
                head, piece = piece.cut(self.size - level)
                self._put(level, head)
        if len(piece):
            self._put(self.level_for(len(piece)), piece)

    def level_for(self, n: int) -> int:
        """The level whose use leaves the least sum of squares; 0 is a new window. Of equal ones the fullest."""
        full = self.size - n
        counts, after = self.counts[: full + 1], self.counts[n:]
        change = 2 * (after - counts) + 2  # one window leaves a level and one comes to another
        change[full] = 1 - 2 * counts[full]  # a full window counts at no level
        change[0] = 2 * after[0] + 1
        usable = np.flatnonzero(counts)
        usable = usable if len(usable) and usable[0] == 0 else np.concatenate([[0], usable])
        cost = change[usable]
        return int(usable[len(cost) - 1 - cost[::-1].argmin()])

    def _put(self, level: int, piece: Piece) -> None:
        if level:
            self.counts[level] -= 1
            self.open -= 1
            window = self.at[level].pop()
        else:
            window = []
        window.append(piece)
        level += len(piece)
        if level == self.size:
            self.done.append(window)
        else:
            self.counts[level] += 1
            self.open += 1
            self.at[level].append(window)

    def finish(self) -> None:
        """Complete what is open, fullest windows first, with pieces of the emptiest; cut the rest at powers of two."""
        left = [(level, window) for level in np.flatnonzero(self.counts)[::-1].tolist() for window in self.at[level]]
        spare = [piece for _, window in reversed(left) for piece in reversed(window)]
        # ``spare`` ends with the first piece of the fullest window, so popping rebuilds the windows in order
        window, room = [], self.size
        total = sum(map(len, spare))
        while spare:
            if not window:
                room = self.size if total >= self.size else 1 << (total.bit_length() - 1)
                total -= room
            piece = spare.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                spare.append(rest)
            window.append(piece)
            room -= len(piece)
            if not room:
                self.done.append(window)
                window = []
        self.counts[:] = 0
        self.at = [[] for _ in range(self.size + 1)]
        self.open = 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_path: str, packing: Packing = Packing()) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids are those of its whole text, without special tokens added, and ``packing.last``. A null or
    empty text has that one alone. Every row is a document, also with a repeated or null doc_id; other columns
    than doc_id and text are not looked at. Sequences have ``packing.window`` ids, but for a few whose length is a
    power of two, at most one of each such length for every task. Each task packs the rows it reads, in their
    order: no exchange, and a task that is run again gives the same rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    last = np.uint32(packing.last)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = words(sent.value), Packer(packing)
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def take() -> None:
            nonlocal first
            for window in packer.done:
                offset = 0
                for p in window:
                    rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, first, offset))
                    offset += len(p)
                first += 1
            packer.done.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

        for batch in with_rows(batches):
            doc_ids = batch.column(0).to_pylist()
            for row, ids in encoder.encode(batch.column(1)):
                packer.add(Piece(doc_ids[row], 0, np.append(ids, last).astype("<u4").tobytes(), len(ids) + 1))
                if len(packer.done) >= ROWS_OUT:
                    take()
                    yield batch_of(rows)
                    rows.clear()
        packer.finish()
        take()
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
