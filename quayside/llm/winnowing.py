"""Document fingerprints by winnowing, in column expressions only.

The hashes of all runs of ``gram`` code points are taken in windows of ``window``, and every window's smallest hash
is chosen, the rightmost one of equal ones, with its position. Texts that share ``gram + window - 1`` code
points in a row share a chosen hash. A hash and its position are one number: 32 bits of hash above 31 bits of
position counted down from the top, so that the smallest number is the rightmost smallest hash. The minimum over a
window comes from doubling: minima over 1, 2, 4, ... neighbours. Long texts go in pieces, so memory stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 20, 32
PIECE = 8192
LAST = 2**31 - 1
ROWS_PER_RANGE = 1000
MOST_RANGES = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression later columns read without repeating it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def windows_in(n_chars: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Number of windows of a text; a text too short for a whole one has one."""
    return F.greatest(n_chars - (gram + window - 2), F.lit(1))


def piece_minima(piece: Column, start: Column, count: Column, gram: int, window: int) -> Column:
    """What the first ``count`` windows of a piece choose; ``start`` is the piece's place in the text."""
    size = F.char_length(piece)
    # every position of a whole code point, looking ahead at the run that begins there
    runs = F.regexp_extract_all(piece, F.lit(r"(?s)(?=([^\p{Cs}].{%d}))" % (gram - 1)), F.lit(1))
    short = F.when(size > 0, F.array(piece)).otherwise(F.expr("array('')").cast("array<string>"))
    grams = F.when(size >= gram, runs).otherwise(short)
    values = F.transform(
        grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 32), 31).bitwiseOR(F.lit(LAST).cast("long") - start - i)
    )

    def doubled(minima: Column, reach: int) -> Column:
        """Minima over ``window`` neighbours from those over ``reach``; fewer at the end."""
        if reach >= window:
            return F.array_distinct(F.slice(minima, F.lit(1), count))
        step = min(reach, window - reach)
        return let(minima, lambda m: doubled(F.zip_with(m, F.slice(m, F.lit(step + 1), F.size(m)), lambda a, b: F.least(a, b)), reach + step))

    return doubled(values, 1)


def chosen(text: Column, first: Column, last: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """What windows ``first`` to ``last - 1`` of a text choose, without repetition; the empty text has nothing."""
    starts = F.sequence(first, last - 1, F.lit(PIECE))
    pieces = F.transform(
        starts,
        lambda s: let(
            F.substring(text, s + 1, F.least(F.lit(PIECE), last - s) + (gram + window - 2)),
            lambda piece: piece_minima(piece, s.cast("long"), F.least(F.lit(PIECE), last - s), gram, window),
        ),
    )
    none = F.expr("array()").cast("array<bigint>")
    return F.when((last > first) & (F.char_length(text) > 0), F.array_distinct(F.flatten(pieces))).otherwise(none)


def hashes_of(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda v: F.shiftright(v, 31)))


def as_text(found: Column) -> Column:
    """Each chosen number as hexadecimal digits: hash * 2**31 + (2**31 - 1 - position)."""
    return F.array_join(F.transform(found, lambda v: F.lower(F.hex(v))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes; 1 if there are none at all."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def by_range(docs: DataFrame) -> DataFrame:
    """Documents with the ``range`` of doc_ids they belong to, in order; ranges hold about equally many rows."""
    n = docs.count()
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE + 1)
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    known = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    place = F.size(F.filter(known, lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    return docs.withColumn("range", F.greatest(place, F.lit(0)))


def following(rows: DataFrame, heads: DataFrame, column: str, into: str) -> DataFrame:
    """``column`` of the next row by doc_id and tie; after the last row of a range the ``head`` of the next range.

    After the last range comes the first. No order over all rows is made in one task, only one over the ranges.
    """
    order = Window.partitionBy("range").orderBy("doc_id", "tie")
    ranges = Window.orderBy("range")
    after = F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    next_heads = heads.select("range", after.alias("after"))
    led = rows.withColumn("led", F.lead(F.struct(column)).over(order))
    return led.join(next_heads, "range").withColumn(into, F.when(F.col("led").isNotNull(), F.col(f"led.{column}")).otherwise(F.col("after"))).drop("led", "after")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, a row per row.

    The edited text is the text with its last quarter of code points, rounded down, replaced by as many from the
    start of the next document, or all it has. The next document is the next row by doc_id and text; after the
    last comes the first, and null doc_ids come before all. Null texts are empty; an empty text has an empty
    fingerprint, a text shorter than ``gram`` the hash of the whole. Likeness is that of the sets of
    hashes; two empty ones are alike. Other columns than doc_id and text are not looked at.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = by_range(base).withColumn("tie", F.sha2("text", 256))
    heads = placed.groupBy("range").agg(F.min(F.struct("doc_id", "tie", "text")).alias("one")).select("range", F.col("one.text").alias("head"))
    rows = following(placed, heads, "text", "next_text").withColumn("n_chars", F.char_length("text"))
    cut = F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")
    rows = once(rows, "edited", F.concat(F.substring("text", F.lit(1), cut), F.substring("next_text", F.lit(1), F.col("n_chars") - cut))).drop("next_text")
    shared = F.greatest(cut - (gram + window - 2), F.lit(0))

    def part(text: str, first: Column, last: Column) -> Column:
        return chosen(F.col(text), first, last, gram, window)

    rows = once(
        rows,
        "parts",
        F.struct(
            part("text", F.lit(0), shared).alias("same"),
            part("text", shared, windows_in(F.col("n_chars"), gram, window)).alias("own"),
            part("edited", shared, windows_in(F.char_length("edited"), gram, window)).alias("new"),
        ),
    )
    rows = rows.select("range", "doc_id", "tie", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "parts")
    both = F.struct(F.array_distinct(F.concat("parts.same", "parts.own")).alias("a"), F.array_distinct(F.concat("parts.same", "parts.new")).alias("b"))
    rows = once(rows, "found", both).drop("parts")
    sets = F.struct(hashes_of(F.col("found.a")).alias("a"), hashes_of(F.col("found.b")).alias("b"))
    rows = once(rows, "sets", sets).select(
        "range", "doc_id", "tie", "n_chars", "edited_sha256", as_text(F.col("found.a")).alias("fingerprint"), as_text(F.col("found.b")).alias("edited_fingerprint"),
        likeness(F.col("sets.a"), F.col("sets.b")).alias("near_edited"), F.col("sets.a").alias("hashes"),
    )
    n = F.char_length("head")
    head_sets = heads.select("range", hashes_of(chosen(F.col("head"), F.lit(0), windows_in(n, gram, window), gram, window)).alias("head"))
    rows = following(rows, head_sets, "hashes", "next_hashes")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
