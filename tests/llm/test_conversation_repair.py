"""Conversation repair: all edit scripts of short conversations tried out, long ones against whole ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quayside.llm.conversation_repair import damaged, repaired, tables

SPACE = "\x20\x09-\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0, 1, 1, 2, 1, *[1] * 15)[code]
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.findall(f"[^{SPACE}]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def scripts(rows, wrong, most):
    """(cost, audit, lines) of every script with a legal end, of all with at most ``most``."""
    found = []

    def go(i, roles, cost, audit, lines):
        if cost > most or not re.fullmatch("(s?(u(au)*a?)?)?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, tuple(lines)))
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", lines)
            if wrong[i] not in ("blank", "duplicate"):
                cut = 3 * (wrong[i] == "truncated")
                go(i + 1, roles + (role[:1] or "?"), cost + cut, audit + "K", [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, roles + new[0], cost + cut + 3, audit + "R", [*lines, f"{new}:{text}"])
        for new in ("user", "assistant"):
            go(i, roles + new[0], cost + 3, audit + "I", [*lines, f"{new}:"])

    go(0, "", 0, "", [])
    return found


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    wrong = faults(rows)
    cost, audit, lines = min(scripts(rows, wrong, 4 * len(rows)))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(wrong.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, digest)


def conversations(seed: int, n: int, rows: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        size = rng.randint(1, rows)
        turns = rng.sample([None, *range(-2, 9)], size)
        texts = ["Yes.", "Yes.", "no", "", " \t", "What? ", "é", "Long text.\n"]
        out += [(conv, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice([*texts, None])) for t in turns]
    return out


def results(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    ids = {r[0] for r in rows}
    hurt = damage(rows)
    return {c: brute([r for r in hurt if r[0] == c]) if any(r[0] == c for r in hurt) else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in ids}


@pytest.mark.parametrize("long_rows", [10_000, 2])
def test_every_script_tried(spark, long_rows):
    rows = conversations(1, 250, 4) + [(None, t, "user", "a.") for t in (1, 3, None)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", h int, symbol string")
    assert results(repaired(damaged(frame), long_rows)) == expected(rows)


def test_long_conversation_in_parts_equals_whole(spark):
    rng = random.Random(8)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system", "x"]), f"{t % 700} {rng.choice(['.', '', '!'])}") for t in range(5000)]
    rows += [(6, 1, "user", "same.")] * 3000
    rows += conversations(3, 20, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = results(repaired(damaged(frame)))
    assert results(repaired(damaged(frame), long_rows=400)) == whole
    assert results(repaired(damaged(frame), long_bytes=3000)) == whole
    assert whole[5][5] > 0 and len(whole[5][6]) >= 4500


def test_empty_table_and_dropped_conversation(spark):
    assert repaired(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "x.")] * 5, SCHEMA)
    nothing = {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert results(repaired(damaged(frame))) == nothing
    assert results(repaired(damaged(frame), long_rows=2)) == nothing


def test_very_long_text(spark):
    text = "word . " * 300_000
    frame = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "x")], SCHEMA)
    row = repaired(frame).first()
    assert (row.truncated, row.cost, row.audit) == (1, 3, "KK")


def test_few_vectors():
    assert len(tables().vectors) < 100
