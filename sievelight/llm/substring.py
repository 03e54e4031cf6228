"""Substring dedup by factors in the manner of relative Lempel-Ziv, found by equality of hashed windows.

It isn't a greedy parse for the longest match at each place: factors are runs of equal windows.

A text is a sequence of words, cut at ASCII white space and compared exactly. Factors are
parsed against reference blocks that between them index the whole corpus: every window of
`least` words is routed to one block by the least hash among its 25-word grams, so a passage
that occurs twice meets itself in the same blocks wherever its copies lie, and each window is
looked up in the only block that can hold it. A block indexes the first occurrence of each
window, in order of (id, position), and factors all others greedily: a factor goes on for
as long as the next window has its first occurrence next to the last one's. The parse goes on
at the next window, not after the factor's last word, so windows across the boundary of two
factors are checked too. Factors, all of `least` words at least, are merged into spans.

Routed windows go through the shuffle as packed arrays, of about 5.5 bytes a word, which a task
gathers over all its texts; their number of blocks follows from the size of the input. A window
whose first occurrence lies in the same chunk of documents is settled there and doesn't take
part, so a passage in very many documents reaches its block once for each chunk.

Defined results: only matches with an earlier document (of lower id) count, so the first
document that holds a passage has no span for it and repetitions inside one document are
none. Rows with equal ids are one document's. Ids that are null or no whole numbers, null and
empty texts and texts of fewer than `least` words have no spans. A text may have any number of
words. An empty table gives no rows. Columns other than id and text are neither read nor touched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import GATHERED, blocks, exchanged, parts_of
from .exchange import ROW as _BLOCK
from .text import chunked, mix64, powers, ranges, ship, span_hashes, utf8, whole, word_spans

#: Words of the shortest duplicate span.
LEAST = 50
_CHUNK = 2 << 20
#: Words whose windows are given their anchors at once; places count within such a stretch.
STRETCH = 1 << 22
_FACTORS = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("ra", T.LongType()), T.StructField("rs", T.IntegerType())])


def gram_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` successive words, by the first."""
    if len(word) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(word))
    acc = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=acc[1:])
    return mix64((acc[size:] - acc[:-size]) * down[: len(word) - size + 1])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive keys."""
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return np.minimum(key[: len(key) - (width - step)], key[width - step :]) if width > step else key


def anchors_of(grams: np.ndarray, span: int) -> np.ndarray:
    """Of each `span` grams in a row the place of the one of least hash (in 40 bits), of equals the first."""
    low = np.uint64((1 << 24) - 1)
    out = []
    for at in range(0, max(0, len(grams) - span + 1), STRETCH):
        part = grams[at : at + STRETCH + span - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_least(key, span) & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def factors_of(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(doc, start, end, reference doc, its start) of the factors, and which windows have an earlier document.

    The windows come in any order; keys are equal where windows are.
    """
    order = np.lexsort((pos, doc, key))
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    ref = order[np.repeat(first, np.diff(np.append(first, len(k))))]
    reference = np.empty(len(k), np.int64)
    reference[order] = ref
    later = doc != doc[reference]
    at = np.flatnonzero(later)
    at = at[np.lexsort((pos[at], doc[at]))]
    d, p, rd, rp = doc[at], pos[at].astype(np.int64), doc[reference[at]], pos[reference[at]].astype(np.int64)
    if len(at):
        # The same window of a document given twice, by repeated rows, goes on as if once.
        goes_on = (d[1:] == d[:-1]) & (rd[1:] == rd[:-1]) & (p[1:] - p[:-1] == rp[1:] - rp[:-1]) & (p[1:] - p[:-1] <= 1)
        head = np.flatnonzero(np.append(True, ~goes_on))
        tail = np.append(head[1:], len(at)) - 1
        return [d[head], p[head], p[tail] + least, rd[head], rp[head]], later
    return [d, p, p, rd, rp], later


def _factor_arrays(f: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(f, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]


def _routed(block: np.ndarray, tag: np.ndarray, doc: np.ndarray, pos: np.ndarray, run: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
    """Runs of windows, one row for each block: how many runs, their tags, documents, places and lengths, and all their windows."""
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    begin = np.cumsum(run) - run
    data = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        h = order[lo:hi]
        inside = np.repeat(begin[h], run[h]) + ranges(run[h])
        data.append(b"".join([np.int64(len(h)).tobytes(), tag[h].tobytes(), doc[h].tobytes(), pos[h].tobytes(), run[h].astype(np.uint16).tobytes(), short[inside].tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(block[order[cuts]], pa.int64()), pa.array(np.zeros(len(cuts), np.int32)), pa.array(data, pa.binary())], [f.name for f in _BLOCK])


def _runs_of(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for kind in (np.uint64, np.int64, np.int32, np.uint16):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(data, np.uint32, -1, at)]


def factors(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Factors (a, s, e, ra, rs): words s to e, e not included, of document a begin as do words rs of document ra."""
    rows = ship(df).select(whole(id_col).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id is not null")
    parts = parts_of(rows)
    many = 4 * parts
    gram = max(1, least // 2)
    span = least - gram + 1  # grams in a window

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rest() -> pa.RecordBatch:
            nonlocal size
            all_of_it = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            size = 0
            return _routed(*all_of_it)

        for b in chunked(batches, "text", _CHUNK):
            raw, off = utf8(b.column("text"))
            start, end = word_spans(raw, off, False)
            if len(start) < least:
                continue
            row = np.searchsorted(off, start, "right") - 1
            word = span_hashes(raw, start, end)
            ids = b.column("id").to_numpy()
            begin = np.searchsorted(row, np.arange(len(ids)))
            whole_windows = gram_hashes(word, least)
            at = np.flatnonzero(row[: len(whole_windows)] == row[least - 1 :])  # windows inside one text
            if not len(at):
                continue
            grams = gram_hashes(word, gram)
            anchor = anchors_of(grams, span)[at]
            doc, pos = ids[row[at]], (at - begin[row[at]]).astype(np.int32)
            found, later = factors_of(whole_windows[at], doc, pos, least)
            if len(found[0]):
                # Settled here; the hash of their document spreads them.
                yield _settled(found, mix64(found[0].astype(np.uint64)) % np.uint64(many))
            at, anchor, doc, pos = at[~later], anchor[~later], doc[~later], pos[~later]
            if not len(at):
                continue
            # Runs of windows that share an anchor, by block.
            head = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(at) != 1)))
            run = np.diff(np.append(head, len(at)))
            tag = grams[anchor[head]]
            held.append(((tag % np.uint64(many)).astype(np.int64), tag, doc[head], pos[head], run, (whole_windows[at] >> np.uint64(32)).astype(np.uint32)))
            size += 4 * len(at) + 30 * len(head)
            if size > GATHERED:
                yield rest()
        if held:
            yield rest()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, data in blocks(batches):
            if kind == _SETTLED:
                found = [np.concatenate(x) for x in zip(*[_factors_in(d) for d in data])]
            else:
                tag, doc, pos, run, short = (np.concatenate(x) for x in zip(*[_runs_of(d) for d in data]))
                run = run.astype(np.int64)
                key = mix64(np.repeat(tag, run) + short.astype(np.uint64))
                found, _ = factors_of(key, np.repeat(doc, run), np.repeat(pos.astype(np.int64), run) + ranges(run), least)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays(_factor_arrays(found), [f.name for f in _FACTORS])

    return exchanged(rows.mapInArrow(route, _BLOCK), parts).mapInArrow(parse, _FACTORS)


_SETTLED = 1


def _settled(found: list[np.ndarray], block: np.ndarray) -> pa.RecordBatch:
    """Factors as rows of their own kind, one for each block."""
    order = np.argsort(block, kind="stable")
    block, flat = block[order], np.stack([x.astype(np.int64) for x in found])[:, order]
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    data = [flat[:, a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(block)))]
    return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int64)), pa.array(np.full(len(cuts), _SETTLED, np.int32)), pa.array(data, pa.binary())], [f.name for f in _BLOCK])


def _factors_in(data: bytes) -> list[np.ndarray]:
    return list(np.frombuffer(data, np.int64).reshape(5, -1))


def spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, start_word, end_word, ref_id, ref_word): the duplicate spans of each document, disjoint.

    Words are counted from 0, end_word isn't included; ref_id, ref_word is where an earlier
    document has the words with which the span begins.
    """
    by_doc = Window.partitionBy("a").orderBy("s", "e", "ra", "rs")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = factors(df, id_col, text, least).withColumn("fresh", F.when(F.col("s") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("s", "ra", "rs"))
    out = marked.groupBy("a", "span").agg(first.alias("f"), F.max("e").alias("e"))
    return out.select(F.col("a").alias(id_col), F.col("f.s").alias("start_word"), F.col("e").alias("end_word"), F.col("f.ra").alias("ref_id"), F.col("f.rs").alias("ref_word"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """df with the duplicate spans cut out of its texts; all rows and columns stay."""
    cuts = spans(df, id_col, text, least).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e")))).alias("cuts"))  # of one document
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), whole(id_col).alias("id"))
    names = df.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("row").flatten()
            texts = columns[place].to_pylist()
            for i, cut in enumerate(b.column("cuts").to_pylist()):
                if cut and texts[i] is not None:
                    data = texts[i].encode()
                    raw = np.frombuffer(data, np.uint8)
                    start, end = word_spans(raw, np.array([0, len(raw)]), False)
                    kept, at = [], 0
                    for c in cut:
                        if c["e"] <= len(end):  # rows of one id may differ
                            kept.append(data[at : start[c["s"]]])
                            at = end[c["e"] - 1]
                    texts[i] = b"".join([*kept, data[at:]]).decode()
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.join(cuts, "id", "left").select("row", "cuts").mapInArrow(run, df.schema)


def sql(least: int = LEAST) -> str:
    """The same spans of table documents in SQL, without their references."""
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - {least - 1})) AS s FROM d WHERE len(w) >= {least}),
g AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {least}], ' ')) AS g FROM i),
o AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE doc_id > f),
b AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {least} THEN 0 ELSE 1 END AS fresh FROM o),
n AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT doc_id, min(s)::INTEGER AS start_word, (max(s) + {least})::INTEGER AS end_word FROM n GROUP BY doc_id, k"""
