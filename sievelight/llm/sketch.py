"""Document frequencies of words as a fixed-size array of counters over the whole table.

A word counts in the cell that its hash picks, so a cell holds at least its words' true
frequencies. The array has the same size for any corpus, which makes it fit to broadcast;
tasks count all their texts and the arrays are summed in a tree, 32 to a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunked, ship

CELLS = 1 << 20
_ROW = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("cells", T.BinaryType())])


def _row(part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["part", "cells"])


def frequencies(df: DataFrame, text: str, hashes: Callable[[pa.Array], np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Counts of hashes(text column) by hash modulo `cells`, over every row of df.

    hashes: gives the 64-bit hashes to count for a chunk, each as often as it counts.
    An empty table gives zeros. A cell that would overflow stays at the largest count.
    """
    ship(df)
    mask = np.uint64(cells - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(cells, np.int64)
        for b in chunked(batches, text):
            h = hashes(b.column(text))
            if len(h) > cells // 8:
                total += np.bincount((h & mask).astype(np.int64), minlength=cells)
            else:
                np.add.at(total, (h & mask).astype(np.int64), 1)
        if total.any():
            yield _row(TaskContext.get().partitionId(), np.minimum(total, 2**32 - 1).astype(np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, got in zip(b.column("part").to_pylist(), b.column("cells")):
                new = np.frombuffer(got.as_buffer(), np.uint32).astype(np.int64)
                sums[part] = sums[part] + new if part in sums else new
        for part, total in sums.items():
            yield _row(part, np.minimum(total, 2**32 - 1).astype(np.uint32))

    narrow = df.select(F.col(f"`{text}`"))
    rows, nodes = narrow.mapInArrow(count, _ROW), narrow.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // 32)
        rows = rows.withColumn("part", (F.col("part") / 32).cast("int")).repartition(nodes, "part").mapInArrow(merge, _ROW)
    got = rows.collect()  # one array at most
    return np.frombuffer(got[0].cells, np.uint32) if got else np.zeros(cells, np.uint32)


def presence(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], cells: int = CELLS * 8) -> np.ndarray:
    """Bits, packed, by hash modulo `cells`: which cells some hash of the rows of df falls into."""
    mask = np.uint64(cells - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(cells, np.uint8)
        for b in batches:
            seen[(hashes(b) & mask).astype(np.int64)] = 1
        if seen.any():
            yield _row(TaskContext.get().partitionId(), np.packbits(seen))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for part, got in zip(b.column("part").to_pylist(), b.column("cells")):
                new = np.frombuffer(got.as_buffer(), np.uint8)
                whole[part] = whole[part] | new if part in whole else new
        for part, bits in whole.items():
            yield _row(part, bits)

    rows, nodes = df.mapInArrow(mark, _ROW), df.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // 32)
        rows = rows.withColumn("part", (F.col("part") / 32).cast("int")).repartition(nodes, "part").mapInArrow(merge, _ROW)
    got = rows.collect()
    return np.frombuffer(got[0].cells, np.uint8) if got else np.zeros(cells // 8, np.uint8)
