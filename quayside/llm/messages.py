"""Compact rows between batches of documents and buckets of hashes.

Grouped tasks exchange many integers. Instead of one row for each, a row holds arrays of them, packed in the
narrowest integer type, addressed to the batch or bucket ``to``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

FIELDS = 6
MESSAGE = T.StructType(
    [T.StructField("to", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType())]
    + [T.StructField(f"f{i}", T.BinaryType()) for i in range(FIELDS)]
)
_ARROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())] + [(f"f{i}", pa.binary()) for i in range(FIELDS)])


def pack(values: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them: its code, then all first bytes, all second bytes, and so on.

    Bytes of one rank together are mostly zeros for the higher ranks, which compression then removes.
    """
    values = np.asarray(values)
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = np.min_scalar_type(high) if low >= 0 else np.dtype(np.int64)
    return kind.char.encode() + values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    return np.frombuffer(data, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)


def messages(rows: list[tuple]) -> pa.Table:
    """Rows of (to, kind, n, field, field, ...)."""
    padded = [tuple(r) + (None,) * (len(_ARROW) - len(r)) for r in rows]
    columns = list(zip(*padded, strict=True)) if padded else [[]] * len(_ARROW)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def joined(table: pa.Table, kind: int, field: int) -> np.ndarray:
    """All integers of one field of the messages of one kind, in the order of the messages."""
    parts = [unpack(v) for k, v in zip(table["kind"].to_pylist(), table[f"f{field}"].to_pylist(), strict=True) if k == kind]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every key with the places it has, ascending."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part
