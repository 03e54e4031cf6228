"""Arrow text columns as flat numpy buffers: chunks, word spans and word hashes.

All functions work on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Text bytes hashed at once.
SEGMENT_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunked(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that each holds about `limit` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    out = []
    for base in (_P, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    return _powers(1 << max(12, int(n).bit_length()))


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit hashes; changes and returns its argument's copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(8)
def _byte_codes(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, np.uint64)


#: Bytes of a span that are hashed eight at a time; longer spans are hashed by sums over their bytes.
_SHORT = 256
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of each byte span raw[start:end]; equal bytes give equal hashes."""
    size = end - start
    out = mix64(size.astype(np.uint64) * _P + _byte_codes(seed)[0])
    if not len(start):
        return out
    # Eight bytes from any place on, as a number
    at = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix64(out ^ (at[start] & _LOW[np.minimum(size, 8)]))
    rest, done = np.flatnonzero((size > 8) & (size <= _SHORT)), 8
    while len(rest):
        part = at[start[rest] + done] & _LOW[np.minimum(size[rest] - done, 8)]
        out[rest] = mix64((out[rest] + _P) ^ part)
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > _SHORT):
        out[i] = _long_hash(raw[start[i] : end[i]], seed)
    return out


def _long_hash(raw: np.ndarray, seed: int) -> np.uint64:
    total = np.uint64(len(raw))
    up, _ = powers(min(len(raw), SEGMENT_BYTES))
    for low in range(0, len(raw), SEGMENT_BYTES):
        part = raw[low : low + SEGMENT_BYTES]
        total = mix64(np.array([total + (_byte_codes(seed)[part] * up[: len(part)]).sum(dtype=np.uint64)]))[0]
    return total


def _classes(plain: bool) -> np.ndarray:
    """True for bytes that end a word: white space, or all ASCII but letters and digits."""
    sep = np.zeros(256, bool)
    sep[[9, 10, 11, 12, 13, 32]] = True
    if plain:
        sep[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            sep[a:b] = False
    return sep


#: For bytes.translate: 1 for bytes of words.
_SPACE, _PLAIN = ((~_classes(p)).astype(np.uint8).tobytes() for p in (False, True))


def word_spans(raw: np.ndarray, breaks: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words. breaks: byte positions that no word crosses.

    plain: words are runs of ASCII letters and digits and of all other characters beyond
    ASCII, else runs of anything but ASCII white space.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.frombuffer(raw.tobytes().translate(_PLAIN if plain else _SPACE), bool)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([np.zeros(int(inside[0]), np.int64), edge, np.full(int(inside[-1]), len(raw))])
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    both = np.unique(inner[inside[inner] & inside[inner - 1]])
    if len(both):
        edge = np.insert(edge, np.repeat(np.searchsorted(edge, both), 2), np.repeat(both, 2))
    return edge[::2], edge[1::2]


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, in ascending order; the place of each value among them)."""
    code = pa.array(values).dictionary_encode()
    distinct = code.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[code.indices.to_numpy()]


def lower(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Flat values as one list per count."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def with_text_columns(df: DataFrame, text: str, schema: T.StructType, make: Callable[[pa.Array], dict[str, pa.Array]], limit: int = CHUNK_BYTES) -> DataFrame:
    """df with the columns of `schema`, made from chunks of column `text` in Python.

    A column of df that has the name of a new one, in any case, is replaced.
    """
    new = {f.name.lower() for f in schema}
    kept = [f for f in df.schema if f.name.lower() not in new or f.name == text]
    shown = [f for f in kept if f.name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, text, limit):
            made = make(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in shown] + [made[f.name] for f in schema], [f.name for f in shown] + [f.name for f in schema])

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType(shown + list(schema)))


def whole(name: str) -> Column:
    """Column `name` as a whole number; null where it is none, as for ids that are words."""
    return F.col(f"`{name}`").try_cast("bigint")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def without(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id isn't in column `id` of gone; no column's name can clash, as rows travel in a struct."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), whole(id_col).alias("id"))
    return rows.join(gone.select("id"), "id", "left_anti").select("row.*")


def ship(df: DataFrame) -> DataFrame:
    """Lets Python workers on this machine import this package from where the driver did."""
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df
