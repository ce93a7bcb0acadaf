"""Removing byte strings of a given length that occurred before, with sparse enhanced suffix arrays.

Whether a window of 100 bytes occurred before is decided from few suffixes. Every window has an anchor: the
rightmost smallest 32-gram in it by hash. Equal windows have equal anchors at equal offsets, so only suffixes
that start at anchors are sorted. Consecutive windows with one anchor form its context, at most 168 bytes.

1. ``contexts``: anchors of every batch of documents, equal contexts of a batch folded to the first.
2. ``resolve``: by hash of the 32-gram. Equal contexts: all but the first are repeats as a whole. Different
   contexts of one 32-gram have to be compared.
3. ``send``: the batches send the bytes of those contexts alone.
4. ``compare``: for every 32-gram an enhanced suffix array of the contexts. A stack scan over common prefix
   lengths gives the prefix intervals; within one, the same scan over the text to the left gives the groups that
   cannot be extended alike in either direction: maximal repeats with all their occurrences. All but a
   group's first occurrence are repeats.
5. ``apply``: every batch joins what was found about its anchors and cuts the covered bytes.

No task holds more than a batch, or the contexts of some 32-grams. A 32-gram with very many contexts is
compared window by window instead, each under its own hash; equal windows of a batch are folded first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quayside.llm.blocks import mix, text_bytes, total_bytes
from quayside.llm.messages import MESSAGE, by_key, joined, messages, pack, unpack

GRAM = 32
BATCH_BYTES = 4 << 20
CHUNK = 1 << 17
#: A 32-gram with more different contexts than this is compared window by window.
MOST_CONTEXTS = 20_000

_PLACE = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = np.multiply.accumulate(np.full(CHUNK + 1024, _P))
_INVERSES = np.multiply.accumulate(np.full(CHUNK + 1024, _P_INVERSE))

LOST, WANTED, WANTED_BY_WINDOW, FOUND = range(4)


@dataclass
class Batch:
    """The different documents of a batch in order of doc_id and text, and which of them each row is."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    of_row: list[int]


def load(table: pa.Table) -> Batch:
    offsets, whole = text_bytes(table["text"])
    null = np.iinfo(np.int64).min
    ids = [null if i is None else i for i in table["doc_id"].to_pylist()]
    keys = [(i, whole[a:b].tobytes()) for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True)]
    different = sorted(set(keys))
    number = {key: i for i, key in enumerate(different)}
    sizes = np.array([len(t) for _, t in different], np.int64)
    ends = np.cumsum(sizes)
    return Batch(
        np.array([i for i, _ in different], np.int64), ends - sizes, ends,
        np.frombuffer(b"".join(t for _, t in different), np.uint8), [number[k] for k in keys],
    )


@dataclass
class Anchors:
    """In order of place: the anchor's place, the first and last window it belongs to, its document, the hashes."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(batch: Batch, length: int) -> Anchors:
    parts, total = [], len(batch.data)
    for c in range(0, max(0, total - length + 1), CHUNK):
        part = batch.data[c : c + CHUNK + length - 1]
        n = len(part) - length + 1  # windows
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWERS[: len(part)], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSES[: len(part) - GRAM + 1])
        keys = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
        chosen = (_PLACE - (sliding_min(keys, length - GRAM + 1) & _PLACE)).astype(np.int64)
        first = np.searchsorted(batch.ends, c, "right")
        last = np.searchsorted(batch.starts, c + n, "left")
        docs = np.arange(first, last)
        here = np.minimum(batch.ends[docs], c + n) - np.maximum(batch.starts[docs], c)
        doc = np.repeat(docs, np.maximum(here, 0))
        fits = np.arange(c, c + n) + length <= batch.ends[doc]
        starts = fits.copy()
        starts[1:] &= ~fits[:-1] | (chosen[1:] != chosen[:-1])
        low = np.flatnonzero(starts)
        stops = fits.copy()
        stops[:-1] &= ~fits[1:] | (chosen[1:] != chosen[:-1])
        high = np.flatnonzero(stops)
        at = chosen[low]
        context = (sums[high + length] - sums[low]) * _INVERSES[low]
        context = mix(context + (at - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix((high - low + 1).astype(np.uint64)))
        parts.append((at + c, low + c, high + c, doc[low], mix(grams[at] ^ _P), context))
    if not parts:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return Anchors(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def later_equals(values: np.ndarray) -> np.ndarray:
    """Where an equal value stands earlier."""
    later = np.ones(len(values), bool)
    later[np.unique(values, return_index=True)[1]] = False
    return later


def contexts(batch_key: int, table: pa.Table, length: int, buckets: int) -> pa.Table:
    batch = load(table)
    found = anchors(batch, length)
    kept = np.flatnonzero(~later_equals(found.context))
    bucket = bucket_of(found.gram[kept], buckets)
    rows = []
    for to, part in by_key(bucket):
        own = kept[part]
        ids = batch.ids[found.doc[own]]
        rows.append(
            (to, 0, batch_key, pack(found.gram[own] & np.uint64(0xFFFFFFFF)), found.context[own].tobytes(),
             int(ids[0]).to_bytes(8, "little", signed=True), pack(np.diff(ids)), pack(np.diff(own, prepend=0)))
        )
    return messages(rows)


def resolve(bucket: int, table: pa.Table, most_contexts: int) -> pa.Table:
    """First occurrences of contexts; the others are lost, and contexts that share a 32-gram are wanted."""
    parts = []
    for row in table.to_pylist():
        ids = np.concatenate([[int.from_bytes(row["f2"], "little", signed=True)], unpack(row["f3"]).astype(np.int64)]).cumsum()
        number = unpack(row["f4"]).astype(np.int64).cumsum()
        parts.append((unpack(row["f0"]).astype(np.int64), np.frombuffer(row["f1"], np.uint64), ids, number, np.full(len(ids), row["n"])))
    gram, context, ids, number, batch = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((number, ids, gram, context))
    same = (context[order][1:] == context[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    later = np.concatenate([[False], same])
    rows = [(to, LOST, bucket, pack(number[order[later]][part])) for to, part in by_key(batch[order[later]])]
    first = order[~later]
    _, which, several = np.unique(gram[first], return_inverse=True, return_counts=True)
    count = several[which]
    for kind, mask in ((WANTED, (count > 1) & (count <= most_contexts)), (WANTED_BY_WINDOW, count > most_contexts)):
        own = first[mask]
        rows += [(to, kind, bucket, pack(np.sort(number[own][part]))) for to, part in by_key(batch[own])]
    return messages(rows)


def _windows_wanted(batch: Batch, found: Anchors, table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to be compared one by one: anchor number, window, and whether an equal one stands earlier in the batch."""
    number = np.sort(joined(table, WANTED_BY_WINDOW, 0))
    if not len(number):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    count = found.high[number] - found.low[number] + 1
    owner = np.repeat(number, count)
    window = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.low[number], found.high[number], strict=True)])
    seen: dict[bytes, int] = {}
    later = np.array([seen.setdefault(batch.data[w : w + length].tobytes(), i) != i for i, w in enumerate(window)])
    return owner, window, later


def send(batch_key: int, docs: pa.Table, table: pa.Table, length: int, buckets: int) -> pa.Table:
    """The bytes of the wanted contexts to the bucket of their 32-gram; single windows to the bucket of their own hash."""
    if not docs.num_rows or not any(k in (WANTED, WANTED_BY_WINDOW) for k in table["kind"].to_pylist()):
        return messages([])
    batch = load(docs)
    found = anchors(batch, length)
    number = np.sort(joined(table, WANTED, 0))
    key, low, high, at = (found.gram & np.uint64(0xFFFFFFFF)).astype(np.int64)[number], found.low[number], found.high[number], found.at[number]
    to = bucket_of(found.gram[number], buckets)
    owner, window, later = _windows_wanted(batch, found, table, length)
    if len(owner):
        owner, window = owner[~later], window[~later]
        hashes = [hashlib.blake2b(batch.data[w : w + length].tobytes(), digest_size=8).digest() for w in window]
        hashed = np.array([int.from_bytes(h, "little") for h in hashes], np.uint64)
        number = np.concatenate([number, owner])
        key = np.concatenate([key, (hashed & np.uint64(0xFFFFFFFF)).astype(np.int64) | (1 << 32)])
        to = np.concatenate([to, bucket_of(hashed, buckets)])
        low, high, at = np.concatenate([low, window]), np.concatenate([high, window]), np.concatenate([at, found.at[owner]])
    rows = []
    for where, part in by_key(to):
        ids = batch.ids[found.doc[number[part]]]
        text = b"".join(batch.data[a : b + length].tobytes() for a, b in zip(low[part], high[part], strict=True))
        shape = ((at - low)[part] << 8) | (high - low)[part]
        rows.append((where, 0, batch_key, pack(key[part]), pack(shape), ids.astype(np.int64).tobytes(), pack(number[part]), text))
    return messages(rows)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(strings: list[bytes], members: list[int], least: int) -> Iterator[tuple[int, list[int]]]:
    """The interval tree of common prefixes: (length, members) of every interval of at least ``least`` bytes.

    The members are put in the order of their strings; the stack holds the intervals that are still open.
    """
    order = sorted(members, key=strings.__getitem__)
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        shared = common_prefix(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        left = i - 1
        while stack and stack[-1][0] > shared:
            depth, left = stack.pop()
            yield depth, order[left:i]
        if shared >= max(least, 0) and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))


def maximal_repeats(before: list[bytes], after: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, members): groups that share so much around their anchor, and not all more.

    ``before`` holds the text left of each anchor in reverse, ``after`` the text from the anchor on. Groups
    whose repeat is shorter than ``length`` are left out.
    """
    longest = max(map(len, before))
    for right, alike in prefix_intervals(after, list(range(len(after))), length - longest):
        for left, group in prefix_intervals(before, alike, length - right):
            yield left, right, group


def repeated_windows(before: list[bytes], after: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(member, least, most): windows that start so many bytes before the member's anchor occur in an earlier member."""
    if len(before) == 2:
        left, right = common_prefix(*before), common_prefix(*after)
        return [(1, length - right, left)] if left + right >= length else []
    return [
        (member, length - right, left)
        for left, right, group in maximal_repeats(before, after, length)
        for first in [min(group)]
        for member in group
        if member != first
    ]


def compare(table: pa.Table, length: int) -> pa.Table:
    entries = []
    for row in table.to_pylist():
        key, shape, number = unpack(row["f0"]).astype(np.int64), unpack(row["f1"]).astype(np.int64), unpack(row["f3"]).astype(np.int64)
        ids = np.frombuffer(row["f2"], np.int64)
        before, windows = shape >> 8, (shape & 255) + 1
        ends = np.cumsum(windows + length - 1)
        entries.append((key, ids, number, np.full(len(key), row["n"]), before, windows, ends - windows - length + 1, ends, [row["f4"]] * len(key)))
    key, ids, number, batch, before, windows, start, end = (np.concatenate([e[i] for e in entries]) for i in range(8))
    text = [t for e in entries for t in e[8]]
    order = np.lexsort((before, number, ids, key))
    found: list[tuple[int, int, int]] = []
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part) < 2:
            continue
        own = [(text[i][start[i] : start[i] + before[i]][::-1], text[i][start[i] + before[i] : end[i]]) for i in part]
        for member, least, most in repeated_windows([b for b, _ in own], [a for _, a in own], length):
            i = part[member]
            least, most = max(least, before[i] - windows[i] + 1), min(most, before[i])
            if least <= most:
                found.append((i, least, most))
    if not found:
        return messages([])
    which, least, most = (np.array(c, np.int64) for c in zip(*found, strict=True))
    rows = [(to, FOUND, 0, pack(number[which[part]]), pack(least[part]), pack(most[part])) for to, part in by_key(batch[which])]
    return messages(rows)


def covered(batch: Batch, found: Anchors, table: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the batch a repeated window covers."""
    lost = np.concatenate([np.flatnonzero(later_equals(found.context)), joined(table, LOST, 0)])
    _, window, later = _windows_wanted(batch, found, table, length)
    number, least, most = (joined(table, FOUND, i) for i in range(3))
    first = np.concatenate([found.low[lost], window[later], found.at[number] - most])
    last = np.concatenate([found.high[lost], window[later], found.at[number] - least]) + length
    change = np.bincount(first, minlength=len(batch.data) + 1) - np.bincount(last, minlength=len(batch.data) + 1)
    return np.cumsum(change)[: len(batch.data)] > 0


def apply(docs: pa.Table, table: pa.Table, length: int, schema: pa.Schema) -> pa.Table:
    characters = pa.types.is_string(schema.field("kept").type)
    batch = load(docs)
    gone = covered(batch, anchors(batch, length), table, length)
    removed, spans, kept = [], [], []
    for a, b in zip(batch.starts, batch.ends, strict=True):
        own = gone[a:b]
        removed.append(int(own.sum()))
        spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
        left = batch.data[a:b][~own].tobytes()
        kept.append(left.decode("utf-8", "ignore") if characters else left)
    rows = batch.of_row
    new = {
        "n_bytes": [int(batch.ends[i] - batch.starts[i]) for i in rows], "n_removed": [removed[i] for i in rows],
        "n_spans": [spans[i] for i in rows], "kept": [kept[i] for i in rows],
    }
    old = docs.select([f.name for f in schema if f.name not in new])
    return pa.Table.from_arrays([*old.columns, *(pa.array(v, schema.field(k).type) for k, v in new.items())], names=[*old.column_names, *new]).cast(schema)


def without_repeats(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), most_contexts: int = MOST_CONTEXTS, characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, ``kept`` (the bytes left) and the columns named in ``carry``, a row per row.

    Removed are all bytes covered by ``length`` bytes that also start earlier: in a document with smaller
    doc_id, or earlier in the same one. Null texts are empty. Rows with equal doc_id and text are one
    document and get equal results; rows with equal doc_id and different texts follow in order of the text; a
    null doc_id comes first. ``carry`` may name any column but those made here. With ``characters`` ``kept`` is a
    text, without the characters that have lost some of their bytes. Contexts are taken as equal
    if their hashes are: 64 bits within a batch, 96 bits between batches.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    if clash := {"n_bytes", "n_removed", "n_spans", "kept", "batch"} & set(carry):
        raise ValueError(f"rename {sorted(clash)} first")
    batches = max(1, -(-total_bytes(docs, "text") // BATCH_BYTES))
    columns = ["doc_id", *carry]
    placed = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text", *carry
    )
    fields = [placed.schema[c] for c in columns]
    schema = T.StructType(
        [*fields, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if characters else T.BinaryType())]
    )
    out = to_arrow_schema(schema)
    by_batch = placed.groupBy("batch")
    sent = by_batch.applyInArrow(lambda key, t: contexts(key[0].as_py(), t, length, batches), MESSAGE)
    answers = sent.groupBy("to").applyInArrow(lambda key, t: resolve(key[0].as_py(), t, most_contexts), MESSAGE)
    texts = by_batch.cogroup(answers.groupBy("to")).applyInArrow(lambda key, d, t: send(key[0].as_py(), d, t, length, batches), MESSAGE)
    compared = texts.groupBy("to").applyInArrow(lambda key, t: compare(t, length), MESSAGE)
    all_answers = answers.union(compared).groupBy("to")
    return by_batch.cogroup(all_answers).applyInArrow(lambda key, d, t: apply(d, t, length, out), schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
