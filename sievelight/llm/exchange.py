"""Entries of fixed width through the shuffle as packed arrays.

A task gathers its entries, whatever texts they come from, and writes them some megabytes
at a time, one row for each block that they touch: two columns, `block` and `data`, the latter with
the bytes of all columns of the entries by place, so that equal high bytes lie together for
compression. Partitions are sorted by block on the JVM, which spills where it has to, and Python
holds one block at a time. The number of blocks follows from the number of the input's partitions,
so it grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of entries that a task gathers before it writes them.
GATHERED = 8 << 20
ROW = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])
NAMES = [f.name for f in ROW]
Columns = list[tuple[str, type]]


def width(columns: Columns) -> int:
    return sum(np.dtype(k).itemsize for _, k in columns)


def rows_of(block: np.ndarray, values: list[np.ndarray], columns: Columns, kind: int = 0) -> pa.RecordBatch:
    """One row for each block, with its part of the values."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    flat = np.concatenate([np.ascontiguousarray(v.astype(k, copy=False)).view(np.uint8).reshape(len(order), -1) for v, (_, k) in zip(values, columns)], axis=1)[order] if len(order) else np.zeros((0, width(columns)), np.uint8)
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    data = [flat[a:b].T.tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(block)))]
    return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(data, pa.binary())], NAMES)


class Packer:
    """Gathers entries of one kind over the whole task."""

    def __init__(self, columns: Columns, kind: int = 0, limit: int = GATHERED):
        self.columns, self.kind, self.most = columns, kind, max(1, limit // (width(columns) + 8))
        self.held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.n = 0

    def add(self, block: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(block):
            self.held.append((block.astype(np.int64, copy=False), [np.array(v, k) for v, (_, k) in zip(values, self.columns)]))
            self.n += len(block)
        if self.n >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            block = np.concatenate([b for b, _ in self.held])
            values = [np.concatenate(v) for v in zip(*[v for _, v in self.held])]
            self.held, self.n = [], 0
            for at in range(0, len(block), self.most):
                yield rows_of(block[at : at + self.most], [v[at : at + self.most] for v in values], self.columns, self.kind)


def unpack(data: list[bytes], columns: Columns) -> list[np.ndarray]:
    """The columns of the entries of several rows."""
    w = width(columns)
    flat = np.concatenate([np.frombuffer(d, np.uint8).reshape(w, -1) for d in data], axis=1)
    out, at = [], 0
    for _, k in columns:
        n = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n].T).view(k).ravel())
        at += n
    return out


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(block, kind, data of its rows) of rows sorted by block and kind; one at a time is held."""
    now: tuple[int, int] | None = None
    held: list[bytes] = []
    for b in batches:
        for block, kind, data in zip(*[b.column(n).to_pylist() for n in NAMES]):
            if (block, kind) != now and held:
                yield *now, held
                held = []
            now = block, kind
            held.append(data)
    if held:
        yield *now, held


def parts_of(df: DataFrame) -> int:
    """Partitions for an exchange of about the size of df: those of the session, or of df where it has more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def exchanged(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by block, each partition in order of (block, kind)."""
    given = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition("block") if parts <= given else rows.repartition(parts, F.col("block"))
    return met.sortWithinPartitions("block", "kind")
