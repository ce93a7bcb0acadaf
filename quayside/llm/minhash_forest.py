"""Near duplicates by an LSH forest.

Documents are sets of word shingles. Equal sets are folded first. Every tree of the forest is the list of all
signatures in the order of its own few minimum hashes, sorted across the cluster by range, so that no group
of copies, however large, meets in one task. Rows that share the first hashes with their neighbours form a region;
its documents are candidates of each other. A region adapts its depth: one with more rows than a block holds is
cut into overlapping windows along the deeper hashes, so that those with the longest common prefixes meet first. When
the windows of all trees are confirmed, what is left of such regions, and of those that a border between tasks cuts, is
compared in full: parts of about the same size and not yet one component meet two by two, half a block each.

Candidates are confirmed a few trees at a time, on the full sets, all with all of a region. What is linked counts as one
from then on, and a region whose documents are all connected is not looked at again in later trees. Two documents that
meet in small regions of several trees after the first are compared in one of them only. A turn exchanges the texts that it
compares and few others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.blocks import Block, blocks, handed_back, mix, possibly, record_batch, stored, with_rows, word_hashes

SHINGLE = 5
#: Tell the places within a shingle apart.
STEPS = np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    """``trees`` orders of ``depth`` hashes each; candidates share ``least`` of them from the first on.

    A window has ``block`` documents or ``shingles`` shingles at most (but one document at least), all of which are
    compared; each begins in the middle of the one before. ``rounds``: trees confirmed at a time, the rest at last.
    """

    trees: int = 20
    depth: int = 6
    least: int = 2
    block: int = 2000
    shingles: int = 4_000_000
    rounds: tuple[int, ...] = (1, 3, 6)


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending in each row, and how many each row has.

    With fewer than five words, the whole sequence is the one shingle; without words the set is empty.
    """
    hashes, sizes = word_hashes(block)
    ends = np.cumsum(sizes)
    place = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
    value = np.zeros(len(hashes), np.uint64)
    for k in range(min(SHINGLE, len(hashes))):
        part = mix(hashes + STEPS[k])
        value[: len(hashes) - k] += part[k:] if k else part
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = place <= np.repeat(sizes, sizes) - SHINGLE
    value, row = mix(value[whole]), row[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = [hashes[ends[i] - sizes[i] : ends[i]] for i in short]
        extra = [mix(np.sum(mix(w + STEPS[: len(w)]), keepdims=True) + np.uint64(len(w))) for w in own]
        value, row = np.concatenate([value, *extra]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(sizes))


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the minimum hashes of all trees as bytes; no exchange."""
    factors = _factors(forest.trees * forest.depth)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("signature", pa.binary())])
        for batch in with_rows(batches):
            for block in blocks(batch.column(1)):
                values, sizes = shingle_sets(block)
                filled = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[filled]
                minima = np.zeros((block.rows, len(factors)), ">u4")
                sums = np.zeros((2, block.rows), np.uint64)
                if len(filled):
                    for i, factor in enumerate(factors):
                        minima[filled, i] = np.minimum.reduceat(values * factor >> np.uint64(32), starts)
                    sums[0, filled] = np.add.reduceat(mix(values), starts)
                    sums[1, filled] = np.add.reduceat(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                yield record_batch(
                    {
                        "doc_id": batch.column(0).slice(block.first, block.rows), "n_shingles": sizes,
                        "a": sums[0].view(np.int64), "b": sums[1].view(np.int64),
                        "signature": [row.tobytes() if n else None for row, n in zip(minima, sizes, strict=True)],
                    },
                    schema,
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(lambda batches: handed_back(run(batches)), "doc_id long, n_shingles long, a long, b long, signature binary")


def _region_starts(trees: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Marks rows that do not share tree and first hashes with the row before."""
    new = np.ones(len(trees), bool)
    new[1:] = (trees[1:] != trees[:-1]) | (keys[1:, :least] != keys[:-1, :least]).any(axis=1)
    return new


def candidates(reps: DataFrame, forest: Forest) -> DataFrame:
    """tree, block, region, doc_id: documents that are candidates of each other, in regions that are part of one block.

    ``members``: how many rows the region has.
    Rows with ``whole``, the first hashes, instead of block, region and members belong to regions that may not lie in one block
    as a whole. They come in addition, maybe twice.
    """
    width = 4 * forest.depth
    trees = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width))))
    rows = reps.select("doc_id", F.greatest(F.col("n_shingles") / forest.shingles, F.lit(1 / forest.block)).alias("weight"), trees.alias("tree", "key"))
    parts = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    schema = pa.schema([("tree", pa.int32()), ("block", pa.int64()), ("region", pa.int64()), ("members", pa.int64()), ("doc_id", pa.int64()), ("whole", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [TaskContext.get().partitionId() << 32] * 2  # of the next block and the next region

        def packed(table: pa.Table, keys: np.ndarray, weight: np.ndarray, cut: bool, end: bool) -> Iterator[pa.RecordBatch]:
            """Whole regions to blocks; those of one row are none. The first may have begun earlier, the last may go on."""
            starts = np.flatnonzero(_region_starts(table["tree"].to_numpy(), keys, forest.least))
            region = np.cumsum(np.bincount(starts, minlength=len(keys))) - 1
            size = np.bincount(region)
            heavy = np.bincount(region, weight)
            divided = heavy > 1
            divided[:1] |= cut
            divided[-1:] |= end
            yield from unfinished(table.filter(pa.array(divided[region])))
            small = (size > 1) & (heavy <= 1)
            place = np.full(len(size), -1)
            place[small] = (np.cumsum(np.where(small, heavy, 0)) // 1).astype(np.int64)[small]
            inside = small[region]
            if inside.any():
                yield part(table, inside, place[region][inside], region[inside])
            for r in np.flatnonzero(heavy > 1):
                yield from windows(table.slice(int(starts[r]), int(size[r])), weight[starts[r] : starts[r] + size[r]])

        def windows(table: pa.Table, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
            half = (np.cumsum(weight) * 2).astype(np.int64)
            for first in range(int(half[0]), max(int(half[0]) + 1, int(half[-1]))):
                own = (half >= first) & (half <= first + 1)
                if own.sum() > 1:
                    yield part(table, own, np.zeros(own.sum(), np.int64), np.zeros(own.sum(), np.int64))

        def unfinished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(table):
                whole = [key[: 4 * forest.least] for key in table["key"].to_pylist()]
                none = [None] * len(table)
                yield record_batch({"tree": table["tree"].to_numpy(), "block": none, "region": none, "members": none, "doc_id": table["doc_id"].to_numpy(), "whole": whole}, schema)

        def part(table: pa.Table, own: np.ndarray, block: np.ndarray, region: np.ndarray) -> pa.RecordBatch:
            some = table.filter(pa.array(own))
            out = {
                "tree": some["tree"].to_numpy(), "block": block + number[0], "region": region + number[1],
                "members": np.bincount(region)[region], "doc_id": some["doc_id"].to_numpy(), "whole": [None] * len(some),
            }
            number[0] += int(block.max()) + 1
            number[1] += int(region.max()) + 1
            return record_batch(out, schema)

        held, cut = None, True  # what is held begins in the middle of a region, as far as is known
        for batch in with_rows(batches):
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = np.frombuffer(b"".join(table["key"].to_pylist()), ">u4").reshape(-1, forest.depth)
            weight = table["weight"].to_numpy()
            last = int(np.flatnonzero(_region_starts(table["tree"].to_numpy(), keys, forest.least))[-1])
            if last:
                yield from packed(table.slice(0, last), keys[:last], weight[:last], cut, False)
                cut = False
            # of a very long region, which may go on, only the last half window is kept
            if weight[last:].sum() > 4:
                yield from windows(table.slice(last), weight[last:])
                yield from unfinished(table.slice(last))
                cut = True
                behind = np.cumsum(weight[::-1])[::-1]
                last = max(last, int(np.flatnonzero(behind > 0.5)[-1]))
            held = table.slice(last)
        if held is not None:
            keys = np.frombuffer(b"".join(held["key"].to_pylist()), ">u4").reshape(-1, forest.depth)
            yield from packed(held, keys, held["weight"].to_numpy(), cut, True)

    return ordered.select("doc_id", "weight", "tree", "key").mapInArrow(run, "tree int, block long, region long, members long, doc_id long, whole binary")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the undirected edges (low, high).

    With ``most`` it may end after so many rounds; a root is then any smaller node that is reachable.

    Alternates moving larger and smaller neighbours to the smallest one. Each round's edges are written, so that
    a lost executor repeats one round at most; the number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(edges.select("low", "high").where("low < high").distinct(), "edges")
    before, done = None, 0
    while True:
        both = edges.union(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # every node u (low) sends its larger neighbours to the smallest of u and its neighbours
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("root"))
        large = both.where("high > low").join(least, "low").select(F.col("root").alias("low"), "high").where("low < high").distinct()
        # every node u (high) and its smaller neighbours go to the smallest of them
        own = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(own, "high").select(F.col("root"), F.explode(F.array("low", "high")).alias("high"))
        edges = stored(small.select(F.col("root").alias("low"), "high").where("low < high").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        done += 1
        if now == before or done == most:
            return edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
        before = now


#: Of a shingle in up to so many sets all pairs are counted one by one; others by a matrix product of so many shingles.
FEW_SETS, MATRIX = 12, 2048


def shared(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many elements each two of the sets have in common; the sets lie in ``values`` one after the other."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    common = np.zeros((n, n), np.float32)
    flat = common.reshape(-1)
    for k in range(2, FEW_SETS + 1):
        some = starts[counts == k]
        if len(some):
            sets = owner[some[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            np.add.at(flat, (sets[:, i] * n + sets[:, j]).ravel(), 1)
    common += common.T
    many = np.flatnonzero(counts > FEW_SETS)
    for at in range(0, len(many), MATRIX):
        own = many[at : at + MATRIX]
        has = np.zeros((n, len(own)), np.float32)
        places = np.repeat(starts[own], counts[own]) + np.arange(counts[own].sum()) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        has[owner[places], np.repeat(np.arange(len(own)), counts[own])] = 1
        common += has @ has.T
    return common


def confirmed_roots(rows: pa.Table, share: int) -> pa.Table:
    """Links low, high between the roots in one block, enough to connect all whose documents are linked in a region."""
    roots, regions = rows["root"].to_numpy(), rows["region"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.ones(0, np.int64))]
    for region in np.unique(regions):
        at = np.flatnonzero(regions == region)
        parts = [shingle_sets(block) for block in blocks(rows["text"].take(pa.array(at)).combine_chunks())]
        values, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        common = shared(values, sizes)
        union = sizes[:, None] + sizes[None, :] - common
        i, j = np.nonzero(np.triu((common > 0) & (100 * common.astype(np.float64) >= share * union), 1))
        low, high = np.minimum(roots[at[i]], roots[at[j]]), np.maximum(roots[at[i]], roots[at[j]])
        found.append((low, high))
    low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.array([low, high])[:, low != high], axis=1).tolist()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for a, b in zip(*pairs, strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    star = [(find(x), x) for x in root if find(x) != x]
    return pa.table({"low": pa.array([a for a, _ in star], pa.int64()), "high": pa.array([b for _, b in star], pa.int64())})


def part_pairs(members: DataFrame, forest: Forest, share: int) -> DataFrame:
    """block, doc_id, root: all pairs of a region's documents that may be linked and have different roots meet in a block.

    ``members``: tree, whole, doc_id, root, n_shingles. Linked sets are of the same size class or of neighbouring ones.
    Components that fill half a block have parts of their own, which do not meet each other.
    """
    region, group = ["tree", "whole"], ["tree", "whole", "size", "of"]
    opened = members.groupBy(*region).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select(*region)
    size = F.floor(F.log("n_shingles") / F.log(F.lit(100 / share))) if share < 100 else F.col("n_shingles")
    weight = F.greatest(F.col("n_shingles") / forest.shingles, F.lit(1 / forest.block))
    rows = members.join(opened, region, "left_semi").select(*region, "doc_id", "root", size.alias("size"), weight.alias("weight"))
    sums = rows.groupBy(*region, "size", "root").agg(F.sum("weight").alias("sum"))
    named = sums.select(*region, "size", "root", "sum", F.when(F.col("sum") > 0.5, F.col("root")).otherwise(F.lit(-1)).alias("own"), (F.col("sum") > 0.5).alias("large"))
    named = named.select("*", F.struct("large", "own").alias("of"))
    parts = named.groupBy(*group).agg(F.ceil(2 * F.sum("sum")).alias("parts"))
    dealt = rows.join(named.select(*region, "size", "root", "of"), [*region, "size", "root"]).join(parts, group)
    dealt = dealt.select(*group, F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", "root")
    each = parts.select(*group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    place = F.struct("size", "of", "part")
    one = each.select(*region, F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("meets"), "size", place.alias("one"))
    other = each.select(*region, F.col("size").alias("meets"), place.alias("other"))
    within = (F.col("one.size") < F.col("other.size")) | (F.col("one") <= F.col("other"))
    apart = ~F.col("one.of.large") | (F.col("one.of") != F.col("other.of"))
    pairs = one.drop("size").join(other, [*region, "meets"]).where(within & apart)
    block = F.xxhash64(*region, "one", "other").alias("block")
    sides = pairs.select(*region, block, F.explode(F.array_distinct(F.array("one", "other"))).alias("side")).select(*region, "block", "side.*")
    return dealt.join(sides, [*group, "part"]).select("block", F.col("block").alias("region"), "doc_id", "root")


#: In regions of so many documents pairs are told apart one by one.
FEW_MEMBERS = 16


def first_meetings(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """tree, block, region, doc_id of the regions that are not one component yet, without what an earlier region compares.

    In a region of few documents stay those that meet one of another component there, and in no such region before.
    """
    rows = regions.join(roots, "doc_id")
    few = F.col("members") <= FEW_MEMBERS
    docs = F.collect_set(F.struct("doc_id", "root")).alias("docs")
    grouped = rows.where(few).groupBy("tree", "block", "region").agg(docs).where(F.size("docs") > 1)
    one = grouped.select("*", F.explode("docs").alias("one"))
    others = F.filter("docs", lambda d: (d["doc_id"] > F.col("one.doc_id")) & (d["root"] != F.col("one.root")))
    pairs = one.select("tree", "block", "region", F.col("one.doc_id").alias("low"), F.explode(others).alias("other"))
    pairs = pairs.select(F.struct("tree", "region", "block").alias("at"), "low", F.col("other.doc_id").alias("high"))
    first = pairs.groupBy("low", "high").agg(F.min("at").alias("at"))
    left = first.select("at.*", F.explode(F.array("low", "high")).alias("doc_id")).distinct()
    columns = ["tree", "block", "region", "doc_id"]
    return left.select(*columns).union(rows.where(~few).select(*columns))


def links(docs: DataFrame, reps: DataFrame, forest: Forest, share: int) -> DataFrame:
    """Confirmed links low, high that connect all candidates that are linked."""
    found_in = stored(candidates(reps, forest), "regions")
    involved = found_in.select("doc_id").distinct()
    roots = stored(involved.withColumn("root", F.col("doc_id")), "roots")
    # documents without a candidate, most of them, are not looked at again
    texts = stored(possibly(docs, roots), "candidate-texts")
    # regions cut by a border or larger than a block; those of one row are none
    whole = found_in.where("whole IS NOT NULL").select("tree", "whole", "doc_id").distinct()
    several = whole.groupBy("tree", "whole").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    whole = stored(whole.join(several, ["tree", "whole"], "left_semi").join(reps.select("doc_id", "n_shingles"), "doc_id"), "whole-regions")
    turns, first = [], 0
    while first < forest.trees:
        turn = len(turns)
        last = forest.trees if turn >= len(forest.rounds) else min(forest.trees, first + forest.rounds[turn])
        turns.append((first, last))
        first = last
    steps, links, step = [(False, t) for t in turns], None, 0
    while step < len(steps):
        in_full, (first, last) = steps[step]
        own = (F.col("tree") >= first) & (F.col("tree") < last)
        if in_full:
            rows = part_pairs(whole.where(own).join(roots, "doc_id"), forest, share)
        else:
            members = found_in.where(own & F.col("region").isNotNull()).join(roots, "doc_id")
            rows = members.select("block", "region", "doc_id", "root")
        # a region of one component has nothing to tell
        opened = rows.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("region")
        rows = stored(rows.join(opened, "region", "left_semi"), "meetings")
        rows = rows.join(possibly(texts, rows), "doc_id").select("block", "region", "root", "text")
        new = stored(rows.groupBy("block").applyInArrow(lambda t: confirmed_roots(t, share), "low long, high long"), "links")
        links = new if links is None else links.union(new)
        step += 1
        if step < len(steps) or not in_full:
            moved = components(new, 2)
            named = roots.join(moved, roots["root"] == moved["node"], "left")
            roots = stored(named.select("doc_id", F.coalesce(moved["root"], roots["root"]).alias("root")), "roots")
        if step == 1:
            found_in = stored(first_meetings(found_in.where((F.col("tree") >= last) & F.col("region").isNotNull()), roots), "first-meetings")
        if step == len(turns):
            left = whole.join(roots, "doc_id").groupBy("tree", "whole").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b")
            rows_left = left.agg(F.sum("n")).first()[0] or 0
            # few rows, as those of regions cut by a border, are not worth a turn for each few trees
            steps += [] if not rows_left else [(True, (0, forest.trees))] if rows_left <= 4 * forest.block else [(True, t) for t in turns]
    return links


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its different shingles of
    five words, the whole sequence if it has fewer, nothing without words. Documents are linked if their sets
    share ``share`` per cent of their union; empty sets are linked with nothing. component_id is the smallest
    doc_id reachable, and ``kept`` says whether it is the own one. Rows with one doc_id are one document, linked by
    any of its texts. A null doc_id is a document of its own that is linked with nothing; it is kept. Other
    columns than doc_id and text are not looked at.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, forest), "signatures")
    sets = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    one = F.min(F.struct("doc_id", "signature"))
    own = sets.groupBy("a", "b", "n_shingles").agg(one.alias("one"), F.count("*").alias("n"))
    reps = stored(own.select("a", "b", "n_shingles", "n", "one.*"), "set-groups")
    found = links(known, reps, forest, share)
    copies = sets.select("a", "b", F.col("doc_id").alias("high")).join(reps.where("n > 1").select("a", "b", F.col("doc_id").alias("low")), ["a", "b"]).select("low", "high")
    root = components(found.union(copies))
    named = signed.select("doc_id", "n_shingles").join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("root", "doc_id")
    return named.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
