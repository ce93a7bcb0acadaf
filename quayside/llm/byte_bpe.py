"""Byte-level BPE encoding and decoding with given merge ranks.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary
finds the longest token from every position of a piece. Encoding walks from left to right with
the longest token that is compatible with the token before it, and backtracks to shorter ones.
Two adjacent tokens are compatible if undoing their merges, latest first, never meets a merge
across the boundary that would have come earlier. Compatibility is memoised, and a position
found to be a dead end is never entered again, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.blocks import handed_back, with_rows

#: A rank file larger than this is refused: it is sent to every executor.
MOST_RANK_BYTES = 64 << 20
#: Pieces kept per worker; beyond that the memory of pieces starts anew.
MOST_PIECES = 300_000
LONGEST_PIECE = 64
#: Documents handed on at a time.
ROWS_OUT = 1000
#: Documents decoded in one step.
DECODED_AT_ONCE = 256


class Vocabulary:
    def __init__(self, rank_file: bytes, pattern: str) -> None:
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._split = regex.compile(pattern).findall
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._compatible: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}

    @functools.cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        """Made for encoding only; a worker that decodes goes without."""
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        return automaton

    def parts(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte or a token that merges never make."""
        if rank not in self._parts:
            ids = [self.ranks[bytes([b])] for b in self.tokens[rank]]
            while len(ids) > 2:
                merged = [self.ranks.get(self.tokens[a] + self.tokens[b], rank) for a, b in zip(ids, ids[1:], strict=False)]
                best = min(merged)
                if best >= rank:
                    break
                at = merged.index(best)
                ids[at : at + 2] = [best]
            self._parts[rank] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self._parts[rank]

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix."""
        if rank not in self._shorter:
            token = self.tokens[rank]
            found = (self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks)
            self._shorter[rank] = next(found, None)
        return self._shorter[rank]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if key not in self._compatible:
            if len(self._compatible) > 4 * MOST_PIECES:
                self._compatible.clear()
            self._compatible[key] = self._stays_apart(left, right)
        return self._compatible[key]

    def _stays_apart(self, left: int, right: int) -> bool:
        before = float("inf")  # a merge across the boundary below this rank would have come first
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < before:
                return False
            of_left, of_right = self.parts(left), self.parts(right)
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:  # at equal ranks the merge further left goes first
                before, right = right + 1, of_right[0]
            else:
                return True

    def _made_by_merges(self, rank: int) -> bool:
        return len(self.tokens[rank]) == 1 or self.parts(rank) is not None

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        longest: list[tuple[int, int]] = [(0, 0)] * len(piece)
        for end, (rank, size) in self._automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > longest[start][1]:
                longest[start] = (rank, size)
        open_at = bytearray(b"\1") * (len(piece) + 1)
        ids: list[int] = []
        at, token = 0, longest[0][0] if piece else None
        while at < len(piece):
            while token is not None:
                end = at + len(self.tokens[token])
                if open_at[end] and self._made_by_merges(token) and (not ids or self.compatible(ids[-1], token)):
                    break
                token = self.shorter(token)
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at][0] if at < len(piece) else None
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes")
                open_at[at] = 0
                token = ids.pop()
                at -= len(self.tokens[token])
        return tuple(ids)

    def encode(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of each piece."""
        return (self.encode_piece(piece.encode()) for piece in self._split(text))

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers; pieces met before are remembered."""
        pieces, known = self._split(text), self._pieces
        missing = [piece for piece in dict.fromkeys(pieces) if piece not in known]
        if not missing:
            return b"".join(map(known.__getitem__, pieces))
        if len(known) + len(missing) > MOST_PIECES:
            known.clear()
            missing = list(dict.fromkeys(pieces))
        own = {piece: array("i", self.encode_piece(piece.encode())).tobytes() for piece in missing}
        known.update((piece, ids) for piece, ids in own.items() if len(piece) <= LONGEST_PIECE)
        return b"".join([own[piece] if piece in own else known[piece] for piece in pieces])

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in one run, where each starts and its size; size -1 for ids that are no token."""
        sizes = np.full(max(self.tokens, default=-1) + 1, -1, np.int64)
        sizes[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        data = np.frombuffer(b"".join(self.tokens[i] for i in np.flatnonzero(sizes >= 0).tolist()), np.uint8)
        return data, np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each gives."""
        data, starts, sizes = self._table
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or (sizes[ids] < 0).any()):
            raise KeyError("there is an id that is no token")
        own = sizes[ids]
        ends = np.cumsum(own)
        return data[np.repeat(starts[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], own


@functools.lru_cache(2)
def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MOST_RANK_BYTES + 1)
    if len(content) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has more than {MOST_RANK_BYTES} bytes")
    return content


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"there is already a column {name}; choose another name for the new one")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _encoded(batches: Iterable[pa.RecordBatch], words: Vocabulary, text: str, into: str) -> Iterator[pa.RecordBatch]:
    for batch in with_rows(batches):
        for at in range(0, batch.num_rows, ROWS_OUT):
            some = batch.slice(at, ROWS_OUT)
            rows = [words.ids(value.as_py() or "") for value in some.column(text)]
            offsets = np.concatenate([[0], np.cumsum([len(row) // 4 for row in rows])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*batch.schema.names, into])


def _decoded(batches: Iterable[pa.RecordBatch], words: Vocabulary, ids: str, into: str) -> Iterator[pa.RecordBatch]:
    for batch in with_rows(batches):
        lists = batch.column(batch.schema.names.index(ids))
        for at in range(0, len(lists), DECODED_AT_ONCE):
            some = lists.slice(at, DECODED_AT_ONCE)
            flat = some.flatten()  # without what lies under a null
            data, sizes = words.decode(flat.to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy())])]
            run = data.tobytes()
            texts = pa.array([run[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(at, DECODED_AT_ONCE).columns, texts], names=[*batch.schema.names, into])


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns and ``into``, the token ids of each whole text.

    Each match of ``pattern`` is encoded by itself, without special tokens. Null and empty texts
    have no ids. A column of the name ``into`` is an error. Rows stay where they are: no exchange.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    schema = _appended(df, into, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, vocabulary(ranks.value, pattern), text, into)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and ``into``, the bytes that the ids stand for; null ids give no bytes, an unknown id is an error."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    schema = _appended(df, into, T.BinaryType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, vocabulary(ranks.value, pattern), ids, into)

    return df.mapInArrow(run, schema)


def token_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens, and the digests of the ids and of the bytes decoded from them.

    ``encode`` and ``decode`` in one Python process a task, which holds one vocabulary.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    texts = docs.select("doc_id", "text")
    columns = ["doc_id", "ids", "decoded"]
    schema = T.StructType([texts.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks.value, pattern)
        return handed_back(batch.select(columns) for batch in _decoded(_encoded(batches, words, "text", "ids"), words, "ids", "decoded"))

    return texts.mapInArrow(run, schema).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
