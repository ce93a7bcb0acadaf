"""Random samples in one pass over the rows, from a reservoir in every task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quayside.session import scratch

_TASK, _SEEN, _AT = "_sample_task", "_sample_seen", "_sample_at"
#: Rows handed on in one batch.
ROWS_OUT = 4096


class Reservoir:
    """``slots`` independent draws, with replacement, from the rows seen so far.

    Until more rows than slots have been seen, all of them are held. From then on a batch of b rows, n rows seen with it,
    replaces each slot with probability b / n by one of its rows: every slot stays uniform over all rows, whatever the
    sizes of the batches. No more than about twice the slots and one batch are held.
    """

    def __init__(self, slots: int, random: np.random.Generator):
        self.slots, self.seen = slots, 0
        self._random = random
        self._rows: pa.Table | None = None
        self._chosen: np.ndarray | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        before = 0 if self._rows is None else self._rows.num_rows
        self.seen += batch.num_rows
        table = pa.Table.from_batches([batch])
        self._rows = table if self._rows is None else pa.concat_tables([self._rows, table])
        if self._chosen is None:
            if self.seen > self.slots:
                self._chosen = self._random.integers(0, self.seen, self.slots)
        else:
            new = np.flatnonzero(self._random.random(self.slots) < batch.num_rows / self.seen)
            self._chosen[new] = before + self._random.integers(0, batch.num_rows, len(new))
        # rows that no slot holds any more go
        if self._chosen is not None and self._rows.num_rows > 2 * self.slots:
            held, self._chosen = np.unique(self._chosen, return_inverse=True)
            self._rows = self._rows.take(held).combine_chunks()

    def rows(self) -> pa.Table | None:
        """All rows seen, if they are no more than the slots; else the slots' rows in the order of the slots."""
        return self._rows if self._chosen is None else self._rows.take(self._chosen)


def reservoir_sample(df: DataFrame, number: int, seed: int = 42) -> DataFrame:
    """Exactly ``number`` rows drawn with replacement, or all rows when there are no more than that, in one pass.

    Every task keeps ``number`` draws of its own rows, or all its rows if there are fewer; that much memory a task is what
    bounds ``number`` (``sample_with_replacement`` has no such bound, but passes over the rows three times). The tasks'
    shares of the sample follow a multinomial draw by their numbers of rows, and a task gives its first draws. Only the
    numbers of rows, one a task, pass through the driver. The same rows in the same partitions give the same sample.
    Nulls and repeated rows are rows like others; no rows give none. The names ``_sample_*`` are taken.
    """
    if number < 0:
        raise ValueError("number is not negative")
    fields = [StructField(name, LongType()) for name in (_TASK, _SEEN, _AT)]
    if clash := {f.name for f in fields} & set(df.columns):
        raise ValueError(f"rename {sorted(clash)} first")
    if number == 0:
        return df.limit(0)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        reservoir = Reservoir(number, np.random.default_rng([seed, task]))
        for batch in batches:
            reservoir.add(batch)
        rows = reservoir.rows()
        if rows is None:
            return
        first = 0
        for batch in rows.to_batches(ROWS_OUT):
            n = batch.num_rows
            own = [np.full(n, task), np.full(n, reservoir.seen), np.arange(first, first + n)]
            names = [*batch.schema.names, _TASK, _SEEN, _AT]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in own)], names=names)
            first += n

    spark = df.sparkSession
    path = scratch(spark, "reservoir")
    df.mapInArrow(keep, StructType([*df.schema.fields, *fields])).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(_TASK).agg(F.max(_SEEN)).collect())
    total = sum(n for _, n in sizes)
    if number >= total:
        return kept.select(*df.columns)
    shares = np.random.default_rng([seed, 1 << 32]).multinomial(number, [n / total for _, n in sizes])
    quota = [(task, n, int(share)) for (task, n), share in zip(sizes, shares, strict=True) if share]
    # one row a task that gives any
    quotas = spark.createDataFrame(quota, f"{_TASK} long, _of long, _share long")
    # a task that kept all its rows: its share is drawn from them here
    drawn = quotas.filter(F.col("_of") <= number).select(_TASK, "_of", F.explode(F.expr("sequence(1L, _share)")).alias("_draw"))
    place = F.pmod(F.xxhash64(F.lit(seed), _TASK, "_draw"), F.col("_of"))
    whole = drawn.groupBy(_TASK, place.alias(_AT)).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    copies = kept.join(whole, [_TASK, _AT]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    slots = kept.join(quotas.filter(F.col("_of") > number), _TASK).filter(F.col(_AT) < F.col("_share"))
    return copies.select(*df.columns).unionByName(slots.select(*df.columns))
