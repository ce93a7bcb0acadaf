"""Repair of the turn structure of conversations by cheapest edits, with Four-Russians block tables.

A row of a conversation is a symbol: the initial of its role, whether its text is cut off, or that it has to go.
The cost of the rest of a conversation, for each state of the automaton of legal role orders, is a vector of
four numbers; less its least number it is one of few. For every block of ``BLOCK`` symbols and every such vector a
table says which vector stands before the block and what it adds. Conversations are processed from their end by
looking up blocks. Then every block is expanded backward again into the vectors between its rows, from which the
edits are read off forward: among the cheapest at each point the first letter, so ties are settled exactly.

The same tables describe a part of a conversation as a mapping of vectors and states. So a conversation of any
length is cut into parts that are processed apart and put together by their mappings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import record_batch, stored, with_rows

DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
BLOCK = 4
#: Symbols: initial (s, u, a, any other) and whether the text is cut off, 2 * initial + cut; must go; nothing.
INITIALS = "sua"
GOES, NOTHING, SYMBOLS = 8, 9, 10
#: States of (s?(ua)+)?: start, after s, after u, after a.
STATES, LAST = 4, (True, False, False, True)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What an inserted or reroled row has to be in each state.
NEEDED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
FAR = 1 << 20
#: A conversation of more rows or bytes is cut into parts.
LONG_ROWS, LONG_BYTES = 10_000, 16 << 20


def _with_inserts(costs: list[int]) -> list[int]:
    """Cheapest in each state if rows may be inserted first."""
    costs = list(costs)
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[NEXT[s, NEEDED[s]]]) for s, c in enumerate(costs)]
    return costs


def _edits(symbol: int, state: int, rest: tuple[int, ...]) -> dict[str, tuple[int, int]]:
    """Cost with the rest and state after each edit of a row but Insert."""
    if symbol == NOTHING:
        return {"": (rest[state], state)}
    found = {"D": (DELETE + rest[state], state)}
    if symbol != GOES:
        own, cut = (INITIALS + "o")[symbol // 2], CUT_OFF * (symbol % 2)
        if (state, own) in NEXT:
            found["K"] = (cut + rest[NEXT[state, own]], NEXT[state, own])
        to = NEXT[state, NEEDED[state]]
        found["R"] = (REROLE + cut + rest[to], to)
    return found


class Choice(NamedTuple):
    """Edits of one row: its audit letters, roles inserted before it, what becomes of it, the state after."""

    audit: str
    inserted: tuple[str, ...]
    becomes: str | None
    state: int


class Tables(NamedTuple):
    """``vectors``: all normalised cost vectors; ``before[symbol, vector]`` and ``added[symbol, vector]`` for one row, the
    same for blocks, and ``choice[symbol, vector after, state]`` with the state it leads to."""

    vectors: list[tuple[int, ...]]
    before: np.ndarray
    added: np.ndarray
    block_before: np.ndarray
    block_added: np.ndarray
    choices: list[Choice]
    choice: np.ndarray
    state: np.ndarray


def _choose(symbol: int, rest: tuple[int, ...], state: int) -> Choice:
    costs = _with_inserts([min(c for c, _ in _edits(symbol, s, rest).values()) for s in range(STATES)])
    audit, inserted = "", []
    while True:
        options = {edit: to for edit, (cost, to) in _edits(symbol, state, rest).items() if cost == costs[state]}
        into = NEXT[state, NEEDED[state]]
        if symbol != NOTHING and INSERT + costs[into] == costs[state]:
            options["I"] = into
        edit = min(options)
        if edit != "I":
            becomes = {"D": None, "": None, "K": ""}.get(edit, ROLE[NEEDED[state]])
            return Choice(audit + edit, tuple(inserted), becomes, options[edit])
        audit += "I"
        inserted.append(ROLE[NEEDED[state]])
        state = into


@lru_cache(1)
def tables() -> Tables:
    end = tuple(_with_inserts([0 if last else FAR for last in LAST]))
    vectors, number = [end], {end: 0}
    steps: list[list[tuple[int, int]]] = []
    for vector in vectors:  # grows while it is read
        own = []
        for symbol in range(SYMBOLS):
            costs = _with_inserts([min(c for c, _ in _edits(symbol, s, vector).values()) for s in range(STATES)])
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            own.append((number[normal], least))
        steps.append(own)
    step = np.array(steps).transpose(2, 1, 0)
    before, added = step[0], step[1]
    block_before, block_added = before, added
    for _ in range(BLOCK - 1):  # one more symbol in front
        block_added = (block_added[None] + added[:, block_before]).reshape(-1, len(vectors))
        block_before = before[:, block_before].reshape(-1, len(vectors))
    choices, number_of = [], {}
    choice = np.zeros((SYMBOLS, len(vectors), STATES), np.int16)
    for symbol, v, state in np.ndindex(choice.shape):
        one = _choose(symbol, vectors[v], state)
        choice[symbol, v, state] = number_of.setdefault(one, len(number_of))
    choices = list(number_of)
    states = np.array([c.state for c in choices], np.int8)[choice]
    return Tables(vectors, before, added, block_before, block_added, choices, choice, states)


#: What is inserted after the last row in each state.
TAIL = ("", "II", "I", "")
TAIL_ROLES = ((), ("user", "assistant"), ("assistant",), ())


def vectors_after(symbols: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that lie one after the other: the vector after every row, the vector before each sequence, and its cost.

    ``ends``: the vector after each sequence. The cost is that of the vector's cheapest state.
    """
    t = tables()
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    places = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + BLOCK * np.repeat(first, sizes)
    padded = np.full(BLOCK * int(blocks.sum()), NOTHING, np.int64)
    padded[places] = symbols
    by_block = padded.reshape(-1, BLOCK)
    codes = by_block @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    after_block = np.zeros(len(codes), np.int64)
    vector, cost = ends.astype(np.int64), np.zeros(len(sizes), np.int64)
    for back in range(1, int(blocks.max(initial=0)) + 1):
        own = np.flatnonzero(blocks >= back)
        at = first[own] + blocks[own] - back
        after_block[at] = vector[own]
        cost[own] += t.block_added[codes[at], vector[own]]
        vector[own] = t.block_before[codes[at], vector[own]]
    inside = np.zeros(by_block.shape, np.int64)
    now = after_block
    for k in range(BLOCK - 1, -1, -1):
        inside[:, k] = now
        now = t.before[by_block[:, k], now]
    return inside.reshape(-1)[places], vector, cost


def traced(symbols: np.ndarray, sizes: np.ndarray, after: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The choice for every row, and the state after each sequence that begins in the state ``starts``."""
    t = tables()
    first = np.cumsum(sizes) - sizes
    state, chosen = starts.astype(np.int64), np.zeros(len(symbols), np.int64)
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        at = first[own] + k
        chosen[at] = t.choice[symbols[at], after[at], state[own]]
        state[own] = t.state[symbols[at], after[at], state[own]]
    return chosen, state


def lines_of(chosen: Iterable[int], roles: Iterable[str], texts: Iterable[str]) -> list[str]:
    choices, out = tables().choices, []
    for number, role, text in zip(chosen, roles, texts, strict=True):
        one = choices[number]
        for inserted in one.inserted:
            out.append(f"{inserted}:")
        if one.becomes is not None:
            out.append(f"{one.becomes or role}:{text}")
    return out


def illegal_pairs(initials: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Marks rows whose initial may not follow the one before; ``same``: whether both are of one conversation."""
    pair = 4 * initials[:-1] + initials[1:]
    return same & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn``, and ``gone``: dropped rows stay as marks of their conversation.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 removes the marks that end sentences, 3 repeats it,
    4 makes it a user's. A null is a blank in the key, in role and in text; a null turn stays null.
    """
    blank = F.lit(" ")
    code = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")), F.lit(20))
    text = F.coalesce(F.col("text"), blank)
    kept = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
        F.when(code <= 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return kept.drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with what one row says of itself: initial (0 to 3), blank, cut; and hashes of role and text."""
    text, role = F.col("text"), F.col("role")
    initial = F.substring(role, 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    base = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
        F.coalesce(gone, F.lit(False)).alias("gone"),
    )
    return base.select(
        "*",
        number.cast("int").alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.xxhash64("text").alias("h"),
    )


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _same_as_before(ids: pa.Array) -> np.ndarray:
    """For all rows but the first, whether the value is that of the row before; null equals null."""
    if len(ids) < 2:
        return np.zeros(0, bool)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return np.asarray(pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))))


def _whole(rows: pa.Table) -> pa.RecordBatch:
    """Results of the conversations whose sorted rows these are."""
    ids = rows["conv_id"].combine_chunks()
    new = np.concatenate([[True], ~_same_as_before(ids)])
    conversation = np.cumsum(new) - 1
    names, n = ids.filter(pa.array(new)), int(new.sum())
    there = ~rows["gone"].to_numpy()
    rows, conversation = rows.filter(pa.array(there)), conversation[there]
    sizes = np.bincount(conversation, minlength=n)
    roles, texts = rows["role"].to_pylist(), rows["text"].to_pylist()
    blank, cut, initial = (rows[c].to_numpy().astype(np.int64) for c in ("blank", "cut", "initial"))
    again = np.zeros(len(texts), np.int64)
    seen: set = set()
    for i, key in enumerate(zip(conversation.tolist(), roles, texts, strict=True)):
        if key in seen:
            again[i] = 1
        else:
            seen.add(key)
    again &= 1 - blank
    cut &= 1 - (blank | again)
    symbols = np.where(blank | again, GOES, 2 * initial + cut)
    after, start, cost = vectors_after(symbols, sizes, np.zeros(n, np.int64))
    chosen, state = traced(symbols, sizes, after, np.zeros(n, np.int64))
    first_costs = np.array([v[0] for v in tables().vectors])
    gaps = np.zeros(n, np.int64)
    known = ~rows["turn"].is_null().to_numpy()
    if known.any():
        turn, owner = rows["turn"].filter(pa.array(known)).to_numpy(), conversation[known]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        last = np.append(first[1:], len(owner)) - 1
        distinct = np.add.reduceat(np.concatenate([[True], (owner[1:] != owner[:-1]) | (turn[1:] != turn[:-1])]).astype(np.int64), first)
        gaps[owner[first]] = turn[last] - turn[first] + 1 - distinct
    wrong = illegal_pairs(initial, conversation[1:] == conversation[:-1]) if len(initial) else np.zeros(0, bool)
    count = lambda marks, of: np.bincount(of[marks.astype(bool)], minlength=n)
    audits, digests, ends = [], [], np.cumsum(sizes)
    choices = tables().choices
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        own = chosen[end - size : end].tolist()
        audits.append("".join([choices[c].audit for c in own]) + (TAIL[state[i]] if size else ""))
        lines = lines_of(own, roles[end - size : end], texts[end - size : end]) + [f"{r}:" for r in (TAIL_ROLES[state[i]] if size else ())]
        digests.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return record_batch(
        {
            "conv_id": names, "gaps": gaps, "blank": count(blank, conversation), "duplicate": count(again, conversation),
            "truncated": count(cut, conversation), "illegal": count(wrong, conversation[1:]), "cost": cost + first_costs[start],
            "audit": audits, "repaired_sha256": digests,
        },
        _ARROW,
    )


def _short(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in with_rows(batches):
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            new = np.flatnonzero(~_same_as_before(table["conv_id"].combine_chunks()))
            last = int(new[-1]) + 1 if len(new) else 0  # the last conversation may go on
            if last:
                yield _whole(table.slice(0, last))
            kept = table.slice(last)
        if kept is not None:
            yield _whole(kept)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "h", "text")
    return ordered.drop("h").mapInArrow(run, RESULT)


def _mapping(conv_id: object, rows: pa.Table) -> pa.Table:
    """One part of a conversation: for each vector after it the vector before and the cost, and the state after it from each state."""
    t = tables()
    n = len(t.vectors)
    rows = rows.sort_by("at")
    symbols, initial = rows["symbol"].to_numpy().astype(np.int64), rows["initial"].to_numpy().astype(np.int64)
    before, cost, states = np.arange(n), np.zeros(n, np.int64), np.zeros((n, STATES), np.int64)
    size = len(symbols)
    for v in range(n):
        after, start, own = vectors_after(symbols, np.array([size]), np.array([v]))
        before[v], cost[v] = start[0], own[0]
        states[v] = traced(np.tile(symbols, STATES), np.full(STATES, size), np.tile(after, STATES), np.arange(STATES))[1]
    wrong = int(illegal_pairs(initial, np.ones(size - 1, bool)).sum())
    return pa.table(
        {
            "conv_id": rows["conv_id"].slice(0, 1), "part": rows["part"].slice(0, 1), "before": pa.array([before], pa.list_(pa.int64())),
            "cost": pa.array([cost], pa.list_(pa.int64())), "states": pa.array([states.ravel()], pa.list_(pa.int64())),
            "illegal": pa.array([wrong], pa.int64()), "first": pa.array(initial[:1]), "last": pa.array(initial[-1:]),
        }
    )


_MAPPING = "conv_id long, part long, before array<long>, cost array<long>, states array<long>, illegal long, first long, last long"


def _placed(parts: pa.Table) -> pa.Table:
    """For every part of one conversation the vector after it and the state it begins in, the conversation's cost and pairs in its first row."""
    parts = parts.sort_by("part")
    before, costs = (np.array(parts[c].to_pylist()) for c in ("before", "cost"))
    states = np.array(parts["states"].to_pylist()).reshape(len(before), -1, STATES)
    n, vector, cost = len(before), 0, 0
    after, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        after[i], cost, vector = vector, cost + costs[i, vector], before[i, vector]
    state = 0
    for i in range(n):
        start[i], state = state, states[i, after[i], state]
    edges = illegal_pairs(np.stack([parts["last"].to_numpy()[:-1], parts["first"].to_numpy()[1:]], 1).ravel(), np.arange(2 * n - 3) % 2 == 0) if n > 1 else np.zeros(0, bool)
    none = [None] * (n - 1)
    return pa.table(
        {
            "conv_id": parts["conv_id"], "part": parts["part"], "after": after, "start": start, "final": np.arange(n) == n - 1,
            "cost": pa.array([cost + tables().vectors[vector][0], *none], pa.int64()),
            "illegal": pa.array([int(edges.sum()) + sum(parts["illegal"].to_pylist()), *none], pa.int64()),
        }
    )


def _part_text(rows: pa.Table, place: pa.Table) -> pa.Table:
    """Audit letters and repaired lines of one part."""
    rows = rows.sort_by("at")
    symbols = rows["symbol"].to_numpy().astype(np.int64)
    size = np.array([len(symbols)])
    after, _, _ = vectors_after(symbols, size, place["after"].to_numpy())
    chosen, state = traced(symbols, size, after, place["start"].to_numpy())
    lines = lines_of(chosen.tolist(), rows["role"].to_pylist(), rows["text"].to_pylist())
    audit = "".join([tables().choices[c].audit for c in chosen.tolist()])
    if place["final"][0].as_py():
        audit += TAIL[state[0]]
        lines += [f"{r}:" for r in TAIL_ROLES[state[0]]]
    body = "\n".join(lines).encode() if lines else None
    return pa.table({"conv_id": rows["conv_id"].slice(0, 1), "part": rows["part"].slice(0, 1), "audit": [audit], "body": pa.array([body], pa.binary())})


def _digests(parts: DataFrame) -> DataFrame:
    """Audit and digest of whole conversations from their parts, read one after the other."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, digest, empty = None, [], None, True

        def row() -> pa.RecordBatch:
            return record_batch({"conv_id": [own[0]], "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]}, schema)

        for batch in with_rows(batches):
            for i in range(batch.num_rows):
                conv_id, _, letters, body = (batch.column(c)[i].as_py() for c in range(4))
                if own != (conv_id,):
                    if own is not None:
                        yield row()
                    own, audit, digest, empty = (conv_id,), [], hashlib.sha256(), True
                audit.append(letters)
                if body is not None:
                    digest.update(body if empty else b"\n" + body)
                    empty = False
        if own is not None:
            yield row()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def _long(rows: DataFrame, total: int, size: int, part_rows: int) -> DataFrame:
    """Conversations of any length, cut by range into parts of about ``part_rows`` rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows), -(-size // LONG_BYTES))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "h", "salt")
    # equal rows may be dealt anyhow
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()), "long-conversations")
    firsts = placed.withColumn("h2", F.xxhash64(F.lit(1), "text")).groupBy("conv_id", "role", "h", "h2").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    goes = F.col("blank") | F.coalesce("again", F.lit(True))
    symbol = F.when(goes, GOES).otherwise(2 * F.col("initial") + F.col("cut").cast("int"))
    marked = stored(placed.join(firsts, "at", "left").withColumn("symbol", symbol), "marked-conversations")
    mappings = marked.select("conv_id", "part", "at", "symbol", F.col("initial").cast("long").alias("initial")).groupBy("conv_id", "part").applyInArrow(lambda key, t: _mapping(key, t), _MAPPING)
    places = stored(
        mappings.groupBy("conv_id").applyInArrow(_placed, "conv_id long, part long, after long, start long, final boolean, cost long, illegal long"), "conversation-parts"
    )
    texts = marked.select("conv_id", "part", "at", "symbol", "role", "text").groupBy("conv_id", "part").cogroup(places.groupBy("conv_id", "part"))
    ends = _digests(texts.applyInArrow(_part_text, "conv_id long, part long, audit string, body binary"))
    # an aggregate for each column of the result; a turn's rows are folded first
    turns = marked.groupBy("conv_id", "turn").agg(
        F.count_if("blank").alias("blank"), F.count_if(goes & ~F.col("blank")).alias("duplicate"), F.count_if(~goes & F.col("cut")).alias("truncated")
    )
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    sums = places.where("cost IS NOT NULL").select("conv_id", "cost", "illegal")
    out = counts
    for other in (sums, ends):
        named = other.withColumnRenamed("conv_id", "other")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("other"))).drop("other")
    return out.select(*[f.name for f in _ARROW])


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A row per conversation: counts of faults, cost and letters of the cheapest edits, and the digest of what they give.

    ``rows`` has conv_id, turn, role, text and, if wanted, ``gone`` (the row only tells that its conversation exists); other
    columns are not looked at. Rows are taken by turn, nulls first; of one turn by role, then by text (its hash).
    A null role or text is a blank; all rows of a null conv_id are one conversation. A row's first fault counts: blank,
    duplicate (role and text seen before), truncated (does not end with . ! or ?). gaps: turns missing between the first and
    the last; illegal: neighbours whose initials are not su, ua or au. Edits are Keep, Rerole, Delete and Insert; role
    initials become (s?(ua)+)?; of the cheapest edits the letters least in ASCII. Without rows all is zero or empty.
    """
    ready = _prepared(rows)
    size = ready.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = size.where((F.col("n") > long_rows) | (F.col("b") > long_bytes))
    some = long.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if not some["n"]:
        return _short(ready)
    named = stored(long.select(F.col("conv_id").alias("other")), "long-conversation-ids")
    own: Column = F.col("conv_id").eqNullSafe(F.col("other"))
    there = ready.join(named, own, "left_semi").where("NOT gone")
    whole = _long(there, int(some["n"]), int(some["b"] or 0), long_rows)
    gone = ready.join(named, own, "left_semi").groupBy("conv_id").agg(F.min("gone").alias("all")).where("all").select("conv_id", F.lit(True).alias("gone"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    return _short(ready.join(named, own, "left_anti")).unionByName(whole).unionByName(_short(_prepared(gone)))
