"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of `cosine` at least is a distance of epsilon at most.
Their leading principal dimensions, from the covariance over all rows, are cut into cells of
side epsilon, and the vectors sorted by cells, dimension by dimension, then by id. The sorted
sequence is cut into intervals of a fixed number of vectors. The join starts from the pair of the
whole sequence with itself and goes down a tree of intervals, dropping every pair whose boxes lie
further apart than epsilon over the leading dimensions; what is left of the lowest level travels
as packed arrays, one task to a pair, in which the same descent goes on to blocks that are then
compared in full. No step drops a pair within epsilon, so the result is exact.

Equal vectors are one entry of the join, and a pair of intervals passes on only the links that
hold its groups together and how many each vector has, so groups of thousands of copies stay
cheap. Every pair of different vectors meets once, so the numbers of links are exact. Groups are
the connected components of the pairs. Work follows the number of pairs of intervals within epsilon over the leading
dimensions: far below the square where the vectors' spectrum falls off, and near it where
every direction is alike.

Defined results: rows whose id is null or no whole number, and vectors that are null, empty, all zero or have an
infinite or NaN element, are in no group and stay. A null element counts 0, and a shorter vector
goes on with zeros. Only directions count, not lengths. Rows with the same id are one entry of
several vectors. Repeated rows change nothing. An empty table gives no groups. Columns other than
id and vector are neither read nor touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, cut
from .simhash import link
from .text import ship, whole, without

COSINE = 0.95
#: Leading principal dimensions with cells, and with box bounds.
CELLS, BOUNDS = 8, 16
#: Dimensions that the principal axes are taken over, at most; later ones only count for distances.
AXES = 256
#: Vectors to an interval (of 2 MB with 64 dimensions), to a block, and intervals to a parent, as bits.
INTERVAL, BLOCK, FAN = 8192, 512, 3
_SLACK = 1e-4  # more than single precision loses

_UNIT = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.BinaryType())])
_SUMS = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("sum", T.DoubleType())])
_KEYED = T.StructType([*_UNIT, T.StructField("key", T.LongType())])
_PACKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("vecs", T.BinaryType()), *[T.StructField(f"{side}{i}", T.DoubleType()) for side in ("lo", "hi") for i in range(BOUNDS)]])
_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def flat_vectors(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of floats as a matrix; null elements count 0, short rows are filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    value = np.asarray((flat.fill_null(0) if flat.null_count else flat).cast(pa.float64()))
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = value
    return out


def units(df: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """(id, vec) of the rows that take part: vec is a unit vector in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = flat_vectors(b.column("v"), width)
            with np.errstate(all="ignore"):
                x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows
                x /= np.sqrt((x * x).sum(1, keepdims=True))
            good = np.isfinite(x).all(1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), _rows(x[good].astype(np.float32) + np.float32(0))], [f.name for f in _UNIT])

    rows = df.select(whole(id_col).alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    return rows.mapInArrow(run, _UNIT)


def _rows(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64).astype(np.int32) * np.int32(step)), pa.py_buffer(x)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def principal_axes(vectors: DataFrame, width: int, axes: int = AXES) -> np.ndarray:
    """Rotation of the first `axes` dimensions, strongest axis first, from sums over all rows of (id, vec)."""
    k = min(width, axes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            x = _matrix(b.column("vec"), width)[:, :k].astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], [f.name for f in _SUMS])

    total = np.zeros((k + 1) ** 2)
    for r in vectors.mapInArrow(add, _SUMS).groupBy("at").agg(F.sum("sum").alias("sum")).collect():  # axes ** 2 rows at most
        total[r["at"]] = r["sum"]
    total = total.reshape(k + 1, k + 1)
    n = max(total[k, k], 1)
    mean = total[k, :k] / n
    _, axis = np.linalg.eigh(total[:k, :k] / n - np.outer(mean, mean))
    return axis[:, ::-1].copy()


def grid_keys(y: np.ndarray, eps: float) -> np.ndarray:
    """Cells of the leading dimensions of y, all within [-1, 1], as integers in grid order."""
    side = 2 * math.ceil((1 + _SLACK) / eps) + 1
    many = max(1, min(CELLS, y.shape[1], int(62 / math.log2(side))))
    cell = np.clip(np.floor(y[:, :many] / eps).astype(np.int64) + side // 2, 0, side - 1)
    return cell @ (side ** np.arange(many - 1, -1, -1, dtype=np.int64))


def gap_squares(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Square of the least distance between two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum())


def interval_links(a: np.ndarray, b: np.ndarray | None, axis: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that hold the groups among the rows of a and b together, or of a alone, as indices into both; and each row's number of links.

    Both are in grid order; halves are joined with halves until blocks are left.
    """
    eps2 = 2 - 2 * cosine + _SLACK
    x = a if b is None else np.concatenate([a, b])
    y = x[:, : len(axis)] @ axis.astype(np.float32)[:, :BOUNDS]
    parent, degree = np.arange(len(x)), np.zeros(len(x), np.int64)
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in boxes:
            boxes[i, j] = y[i:j].min(0), y[i:j].max(0)
        return boxes[i, j]

    todo = [((0, len(a)), (0, len(a)) if b is None else (len(a), len(x)))]
    while todo:
        s, t = todo.pop()
        if s[0] == s[1] or t[0] == t[1] or (s != t and gap_squares(*box(*s), *box(*t)) > eps2):
            continue
        if max(s[1] - s[0], t[1] - t[0]) > BLOCK:
            halves = [[(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])] if r[1] - r[0] > BLOCK else [r] for r in (s, t)]
            todo += [(p, q) for p in halves[0] for q in halves[1] if s != t or p <= q]
            continue
        like = x[s[0] : s[1]] @ x[t[0] : t[1]].T
        if s == t:
            like = np.triu(like, 1)
        sure = like >= cosine + _SLACK
        degree[s[0] : s[1]] += sure.sum(1)
        degree[t[0] : t[1]] += sure.sum(0)
        # Single precision can't decide about the others
        i, j = np.nonzero((like >= cosine - _SLACK) & ~sure)
        i, j = i + s[0], j + t[0]
        good = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64)) >= cosine - 1e-9
        i, j = i[good], j[good]
        np.add.at(degree, i, 1)
        np.add.at(degree, j, 1)
        p, q = np.nonzero(sure)
        for lo in range(0, len(p), 1 << 18):
            parent = link(parent, p[lo : lo + (1 << 18)] + s[0], q[lo : lo + (1 << 18)] + t[0])
        parent = link(parent, i, j)
    hang = np.flatnonzero(parent != np.arange(len(x)))
    return hang, parent[hang], degree


def _distant(eps2: float) -> Column:
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"t_hi{i}"), F.col(f"t_lo{i}") - F.col(f"hi{i}")) for i in range(BOUNDS)]
    total = gap[0] * gap[0]
    for g in gap[1:]:
        total = total + g * g
    return total > eps2


def interval_pairs(intervals: DataFrame, parts: int, cosine: float) -> DataFrame:
    """(s, t), s <= t: pairs of intervals that aren't provably distant, found from the top of the tree."""
    eps2 = 2 - 2 * cosine + _SLACK
    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(BOUNDS)]
    leaves = intervals.select(((F.col("part") * 4096) + F.col("nth")).alias("node"), "part", *bounds)  # an interval's place in the sequence
    levels = max(1, math.ceil(math.log2(max(parts, 2)) / FAN))
    pairs: DataFrame | None = None
    for level in range(levels, -1, -1):
        up = F.floor(F.col("part") / (1 << (FAN * (level + 1)))).cast("bigint").alias("parent")
        node = F.floor(F.col("part") / (1 << (FAN * level))).cast("bigint").alias("node") if level else F.col("node")
        up = up if level else F.floor(F.col("part") / (1 << FAN)).cast("bigint").alias("parent")
        boxes = leaves.select(up, node, *bounds)
        if level:
            boxes = boxes.groupBy("parent", "node").agg(*[(F.min if b[:2] == "lo" else F.max)(b).alias(b) for b in bounds])
        other = boxes.select(*[F.col(c).alias(f"t_{c}") for c in boxes.columns])
        if pairs is None:
            met = boxes.join(other, F.col("parent") == F.col("t_parent"))
        else:
            met = pairs.join(boxes, F.col("s") == F.col("parent")).join(other, F.col("t") == F.col("t_parent"))
        pairs = cut(met.where(F.col("node") <= F.col("t_node")).where(~_distant(eps2)).select(F.col("node").alias("s"), F.col("t_node").alias("t")))
    return pairs


def links(distinct: DataFrame, n: int, width: int, axis: np.ndarray, cosine: float) -> DataFrame:
    """Edges (a, b) that hold together the groups among n rows (id, vec); and, with b null, parts of a's number of links n."""
    sent = distinct.sparkSession.sparkContext.broadcast(axis)  # the square of the dimensions, AXES at most
    eps = math.sqrt(max(2 - 2 * cosine, 1e-6))
    parts = max(1, math.ceil(n / INTERVAL))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), width)
            cells = grid_keys(x[:, : len(sent.value)] @ sent.value.astype(np.float32), eps)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cells)], [f.name for f in _KEYED])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            y = x[:, : len(sent.value)] @ sent.value.astype(np.float32)[:, :BOUNDS]
            ends = np.zeros((2, BOUNDS))
            ends[0, : y.shape[1]], ends[1, : y.shape[1]] = y.min(0), y.max(0)
            values = [[part], [nth], [ids.tobytes()], [x.tobytes()], *[[v] for v in ends.ravel()]]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i < 2 else pa.binary() if i < 4 else pa.float64()) for i, v in enumerate(values)], [f.name for f in _PACKED])

        for b in batches:
            held.append((b.column("id").to_numpy(), _matrix(b.column("vec"), width)))
            size += b.num_rows
            while size >= 2 * INTERVAL:
                ids, x = (np.concatenate(v) for v in zip(*held))
                yield row(ids[:INTERVAL], x[:INTERVAL])
                nth, held, size = nth + 1, [(ids[INTERVAL:], x[INTERVAL:])], size - INTERVAL
        if size:
            yield row(*(np.concatenate(v) for v in zip(*held)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for b in batches:
            for s, t, second, ids, vecs in zip(*[b.column(c).to_pylist() for c in ("s", "t", "second", "ids", "vecs")]):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float32).reshape(-1, width)
                if not second:
                    first = ids, x
                    if s != t:
                        continue
                    i, j, degree = interval_links(x, None, sent.value, cosine)
                else:
                    i, j, degree = interval_links(first[1], x, sent.value, cosine)
                    ids = np.concatenate([first[0], ids])
                some = np.flatnonzero(degree)
                none = pa.nulls(len(i), pa.int64()), pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), none[0]], [f.name for f in _EDGES])
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), none[1], pa.array(degree[some])], [f.name for f in _EDGES])

    keyed = distinct.mapInArrow(key, _KEYED).repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    packed = cut(keyed.select("id", "vec").mapInArrow(pack, _PACKED))
    pairs = interval_pairs(packed, parts, cosine)
    data = packed.select(((F.col("part") * 4096) + F.col("nth")).alias("node"), "ids", "vecs")
    sides = pairs.select("s", "t", F.lit(False).alias("second"), F.col("s").alias("node")).union(pairs.where("s < t").select("s", "t", F.lit(True), F.col("t")))
    # A pair of intervals at a time is held, whatever the number of partitions
    met = sides.join(data, "node").repartition("s", "t").sortWithinPartitions("s", "t", "second")
    return met.select("s", "t", "second", "ids", "vecs").mapInArrow(join, _EDGES)


def _joined(df: DataFrame, id_col: str, vector: str, cosine: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, first) of the vectors, first being the least id of the equal ones; the groups (node, root); and (id, n) links of first."""
    widest = ship(df).agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0]
    width = max(int(widest or 0), 1)
    vectors = cut(units(df, id_col, vector, width))
    equal = vectors.groupBy("vec").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    distinct = cut(equal.select(F.col("first").alias("id"), "vec"))
    found = cut(links(distinct, distinct.count(), width, principal_axes(distinct, width), cosine))
    copies = vectors.join(equal.where("first <> last"), "vec").select("id", "first")
    same = copies.select(F.col("id").alias("a"), F.col("first").alias("b"))
    return copies, components(found.where("b is not null").select("a", "b").union(same)), found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))


def groups(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, keep_id) for every vector that has a near-duplicate of lower id in its group: keep_id is the group's least id."""
    _, found, _ = _joined(df, id_col, vector, cosine)
    return found.where("node <> root").select(F.col("node").alias(id_col), F.col("root").alias("keep_id"))


def classes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, class_id, n_links) for every id: the least id of its group, and how many different vectors are near.

    Copies count as one vector, and have the links of the one that they equal. An id with several
    vectors has the links of all of them; one without a direction is a class of its own.
    """
    copies, found, degree = _joined(df, id_col, vector, cosine)
    ids = df.select(whole(id_col).alias("id")).where("id is not null").distinct()
    entries = copies.where("id <> first").union(ids.select("id", F.col("id").alias("first")))
    counted = entries.join(degree, "first", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))
    return counted.join(found.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), "n_links")


def deduplicate(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """df without the vectors that have a near-duplicate of lower id in their group."""
    return without(df, groups(df, id_col, vector, cosine).select(F.col(id_col).alias("id")), id_col)


def sql(cosine: float = COSINE) -> str:
    """The same classes of table embeddings in SQL."""
    return f"""
WITH RECURSIVE d AS (SELECT embedding AS v, min(vec_id) AS f FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1),
e AS MATERIALIZED (SELECT a.f AS a, b.f AS b FROM d a JOIN d b ON a.f <> b.f AND list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= {cosine}::DOUBLE - 1e-9),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT x.vec_id, least(d.f, coalesce(c.b, d.f)) AS class_id, coalesce(n.n, 0)::BIGINT AS n_links FROM embeddings x JOIN d ON d.v = x.embedding LEFT JOIN c ON c.a = d.f LEFT JOIN n ON n.a = d.f"""
