"""Line dedup: an exact set-similarity join of lines by their words.

A line is the set of its words (lower case, without punctuation). Two lines match when the
Jaccard similarity of their sets is `threshold` at least. Words are ordered by rarity over all
lines, of equals by their hash, and a line enters the join under the words of its prefix only: with n
words, any match shares one of the n - ceil(threshold * n) + 1 rarest. Under each word, lines meet those of a
size that the threshold allows (length filter), unless the places of the word in both leave too
few words to share (positional filter) or 128 parity bits of the sets already differ in more bits
than matching sets can (bitmap filter). None of the filters drops a match. What is left is
verified on the whole sets. A line goes when any earlier line, by (id, number), matches it.

Prefixes travel as packed arrays (module exchange). Equal sets are one entry of the join, in a
chunk and again under each word, so a line in very many documents costs a row for each chunk.
For verification only lines that have a candidate pair travel with their words, in two joins
that may be skewed at will.

Defined results: lines are cut at line feeds and numbered from 0; lines without words, and so
null and empty texts, match nothing and stay. Equal lines within a document match too. Rows
with equal ids are one document whose lines have the same places, so none of two equal rows
removes the other's lines. Ids that are null or no whole numbers take no part. An empty table
gives no rows. A text may have any number of lines, and a line any number of words. Of several
earlier lines that match, the first is named. Columns other than id and text are neither read
nor touched, whatever their names; `deduplicate` also sets the number of characters where df has
that column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .graph import cut
from .exchange import ROW, Packer, blocks, exchanged, parts_of, rows_of, unpack
from .text import chunked, coded, lower, mix64, ranges, ship, span_hashes, utf8, whole, word_spans

THRESHOLD = 0.8
_LEAD = np.uint32(1 << 31)
_EPS = 1e-9


def line_words(column: pa.Array, rank: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, first word, words) of the distinct words of every line that has words.

    Per line: the row of its text, its number there, where its words begin, and how many follow.
    The words themselves, 64-bit hashes, come last: within a line by hash, or by what `rank` gives
    for distinct words in order of their hash, and then by hash.
    """
    raw, off = utf8(lower(column))
    feed = np.flatnonzero(raw == 10)
    start, end = word_spans(raw, off, True)
    word, which = coded(span_hashes(raw, start, end))
    if rank is not None and len(word):
        order = np.argsort(rank(word), kind="stable")
        place = np.empty(len(word), np.int64)
        place[order] = np.arange(len(word))
        word, which = word[order], place[which]
    cuts = np.unique(np.concatenate([off[:-1], feed]))
    line = np.searchsorted(cuts, start, "right") - 1
    # One number for line and word: both are counted within the chunk, so it always fits.
    both = np.sort(line * max(1, len(word)) + which)
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    line, word = both // max(1, len(word)), word[both % max(1, len(word))]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    at = line[first]
    row = np.searchsorted(off, cuts[at], "right") - 1
    # A text that begins with a line feed has its first cut at that feed: it starts line 1.
    number = np.searchsorted(feed, cuts[at], "right") - np.searchsorted(feed, off[row])
    return row, number, np.append(first, len(word)), word


def word_hashes(column: pa.Array) -> np.ndarray:
    raw, off = utf8(lower(column))
    return span_hashes(raw, *word_spans(raw, off, True))


_PREFIX = [("word", np.uint64), ("doc", np.int64), ("line", np.int32), ("set", np.uint64), ("bits", np.uint64), ("more", np.uint64), ("n", np.int32), ("pos", np.uint32)]
_ENDS = [("a", np.int64), ("al", np.int32), ("b", np.int64), ("bl", np.int32)]
_ENTRY, _EQUAL, _MAYBE = 0, 1, 2
_PAIR = T.StructType([T.StructField(c, t) for c, t in (("a", T.LongType()), ("al", T.IntegerType()), ("b", T.LongType()), ("bl", T.IntegerType()), ("equal", T.BooleanType()))])


def _settle(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For entries in `order`, `same` telling which equal the one before: the first of each run, by entry."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.empty(len(order), np.int64)
    out[order] = order[first]
    return out


def _runs(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where fresh is true."""
    start = np.flatnonzero(fresh)
    return start, np.diff(np.append(start, len(fresh)))


def join_block(t: float, word: np.ndarray, doc: np.ndarray, line: np.ndarray, kind: np.ndarray, bits: np.ndarray, more: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(equal lines, candidate pairs), each as (a, al, b, bl) with a the earlier, of one block's entries."""
    if not len(word):
        return [np.zeros(0, k) for _, k in _ENDS], [np.zeros(0, k) for _, k in _ENDS]
    low = np.uint64((1 << 20) - 1)
    # Words that agree in 44 bits count as one here: that adds candidates, and loses none.
    code = (word & ~low) | np.minimum(n, (1 << 20) - 1).astype(np.uint64)
    order = np.lexsort((kind, code))
    fresh = np.append(True, (code[order][1:] != code[order][:-1]) | (kind[order][1:] != kind[order][:-1]))
    start, size = _runs(fresh)
    multi = np.flatnonzero(np.repeat(size > 1, size))
    if len(multi):  # equal sets: the earliest line first
        run = np.repeat(np.arange(len(size)), size)[multi]
        e = order[multi]
        order[multi] = e[np.lexsort((line[e], doc[e], run))]
    first = np.repeat(order[start], size)[multi] if len(multi) else multi
    e = order[multi]
    copy = ((pos[e] & _LEAD) > 0) & ((doc[e] != doc[first]) | (line[e] != line[first]))
    equal = [doc[first[copy]], line[first[copy]], doc[e[copy]], line[e[copy]]]
    order = order[start]
    code, doc, line, bits, more, n = (x[order] for x in (code, doc, line, bits, more, n))
    pos = (pos[order] & ~_LEAD).astype(np.int32)
    # Under a word entries ascend by size: partners of i are i+1 up to the last that is small enough.
    most = np.minimum(np.floor(n / t + _EPS), (1 << 20) - 1).astype(np.uint64)
    many = np.searchsorted(code, (code & ~low) | most, "right") - np.arange(len(code)) - 1
    bound = (n * ((1 - t) / (1 + t)) + _EPS).astype(np.float32)
    out: list[list[np.ndarray]] = [[], []]
    total = np.cumsum(many)
    at = 0
    while at < len(code):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), "right")))
        m = many[at:stop]
        j = np.repeat(np.arange(at + 1, stop + 1), m) + ranges(m)
        differ = np.bitwise_count(np.repeat(bits[at:stop], m) ^ bits[j])
        differ += np.bitwise_count(np.repeat(more[at:stop], m) ^ more[j])
        ok = np.flatnonzero(differ <= np.repeat(bound[at:stop], m) + bound[j])
        i, j = np.repeat(np.arange(at, stop), m)[ok], j[ok]
        need = np.ceil(t / (1 + t) * (n[i] + n[j]) - _EPS)
        ok = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        out[0].append(i[ok])
        out[1].append(j[ok])
        at = stop
    i, j = (np.concatenate(x) for x in out)
    swap = (doc[j] < doc[i]) | ((doc[j] == doc[i]) & (line[j] < line[i]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return equal, [doc[i], line[i], doc[j], line[j]]


def _home(b: np.ndarray, bl: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(b.astype(np.uint64) + mix64(bl.astype(np.uint64))) % np.uint64(blocks)).astype(np.int64)


def _distinct(ends: list[np.ndarray], keys: tuple[int, ...]) -> list[np.ndarray]:
    """The first of the rows that agree in the columns `keys`, in ascending order of (b, bl, a, al)."""
    order = np.lexsort([ends[k] for k in (1, 0, 3, 2)])
    ends = [x[order] for x in ends]
    fresh = np.append(True, np.any([ends[k][1:] != ends[k][:-1] for k in keys], axis=0))[: len(order)]
    return [x[fresh] for x in ends]


def candidates(df: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, al, b, bl, equal) over df (id, text): lines that match, being equal, or may match."""
    parts = parts_of(df)
    many = 4 * parts
    counts = df.sparkSession.sparkContext.broadcast(sketch.frequencies(df, "text", word_hashes))  # 4 MB for any corpus

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        low = np.uint64(len(count) - 1)
        entries, settled = Packer(_PREFIX, _ENTRY), Packer(_ENDS, _EQUAL)
        for b in chunked(batches, "text"):
            # Rarest first; words come in order of their hash, which decides among equals
            row, number, first, word = line_words(b.column("text"), lambda w: count[(w & low).astype(np.int64)])
            if not len(row):
                continue
            n = np.diff(first)
            doc = b.column("id").to_numpy()[row]
            mixed = mix64(word + np.uint64(5))
            kind = np.add.reduceat(mixed, first[:-1])
            bit = np.uint64(1) << (mixed >> np.uint64(58))
            half = (mixed & np.uint64(1)) > 0
            bits, more = (np.bitwise_xor.reduceat(np.where(h, bit, np.uint64(0)), first[:-1]) for h in (half, ~half))
            # Lines equal to an earlier one of the chunk are settled here.
            order = np.lexsort((number, doc, kind, n))
            same = np.append(False, (kind[order][1:] == kind[order][:-1]) & (n[order][1:] == n[order][:-1]))
            origin = _settle(order, same)
            alone = origin == np.arange(len(row))
            copy = np.flatnonzero(~alone & ((doc != doc[origin]) | (number != number[origin])))
            yield from settled.add(_home(doc[copy], number[copy], many), [doc[origin[copy]], number[origin[copy]], doc[copy], number[copy]])
            prefix = np.where(alone, n - np.ceil(threshold * n - _EPS).astype(np.int64) + 1, 0)
            line = np.repeat(np.arange(len(row)), prefix)
            place = ranges(prefix)
            word = word[first[line] + place]
            # A word counted once is in no other line.
            use = np.flatnonzero(count[(word & low).astype(np.int64)] > 1)
            line, word, place = line[use], word[use], place[use].astype(np.uint32)
            if not len(line):
                continue
            place[np.append(True, line[1:] != line[:-1])] |= _LEAD
            yield from entries.add((word % np.uint64(many)).astype(np.int64), [word, doc[line], number[line], kind[line], bits[line], more[line], n[line], place])
        yield from entries.rest()
        yield from settled.rest()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe: list[list[np.ndarray]] = []
        equals = Packer(_ENDS, _EQUAL)

        def give(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            """Candidate pairs of several blocks, those that met under more than one word once."""
            if maybe and (all_of_it or sum(len(p[0]) for p in maybe) > 1 << 19):
                found = _distinct([np.concatenate(x) for x in zip(*maybe)], (0, 1, 2, 3))
                maybe[:] = [found]
                if all_of_it or len(found[0]) > 1 << 18:
                    yield rows_of(_home(found[2], found[3], many), found, _ENDS, _MAYBE)
                    maybe.clear()

        for block, kind, data in blocks(batches):
            if kind == _EQUAL:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(data), pa.int64()), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], [f.name for f in ROW])
                continue
            equal, found = join_block(threshold, *unpack(data, _PREFIX))
            yield from equals.add(_home(equal[2], equal[3], many), equal)
            maybe.append(found)
            yield from give(False)
        yield from give(True)
        yield from equals.rest()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, data in blocks(batches):
            ends = _distinct(unpack(data, _ENDS), (2, 3) if kind == _EQUAL else (0, 1, 2, 3))
            yield pa.RecordBatch.from_arrays([*map(pa.array, ends), pa.array(np.full(len(ends[0]), kind == _EQUAL))], [f.name for f in _PAIR])

    met = exchanged(df.mapInArrow(spread, ROW), parts).mapInArrow(meet, ROW)
    return exchanged(met, parts).mapInArrow(settle, _PAIR)


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarities of a[i] and b[i], sets as packed arrays of distinct hashes."""
    (x, xo), (y, yo) = utf8(a), utf8(b)
    na, nb = np.diff(xo) // 8, np.diff(yo) // 8
    value = np.concatenate([np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64)])
    pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
    distinct, which = coded(value)
    # One number for pair and hash, so that equal ones come side by side
    both = np.sort(pair * max(1, len(distinct)) + which)
    shared = np.bincount(both[1:][both[1:] == both[:-1]] // max(1, len(distinct)), minlength=len(na))
    return shared / np.maximum(na + nb - shared, 1)


_WORDS = T.StructType([T.StructField("x", T.LongType()), T.StructField("xl", T.IntegerType()), T.StructField("words", T.BinaryType())])
_MATCH = T.StructType([T.StructField("b", T.LongType()), T.StructField("bl", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("al", T.IntegerType())])


def _of_doc(doc: pa.Array) -> np.ndarray:
    return mix64(doc.to_numpy().astype(np.uint64))


def _of_line(doc: pa.Array, line: pa.Array) -> np.ndarray:
    return mix64(_of_doc(doc) + mix64(line.to_numpy().astype(np.uint64) + np.uint64(1)))


def _verified(df: DataFrame, maybe: DataFrame, threshold: float) -> DataFrame:
    """(b, bl, a, al): the candidate pairs that match."""
    # Cells of the documents and lines that have candidates: of fixed size, and only spares work.
    needed = df.sparkSession.sparkContext.broadcast(sketch.presence(maybe, lambda r: np.concatenate([_of_doc(r["a"]), _of_doc(r["b"]), _of_line(r["a"], r["al"]), _of_line(r["b"], r["bl"])])))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unpackbits(needed.value)
        low = np.uint64(len(cells) - 1)
        for b in batches:
            b = b.filter(pa.array(cells[(_of_doc(b.column("id")) & low).astype(np.int64)] > 0))
            for c in chunked([b], "text"):
                row, number, first, word = line_words(c.column("text"))
                doc, number = c.column("id").take(pa.array(row)), pa.array(number, pa.int32())
                flat = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer((8 * first).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(word))]).cast(pa.binary())
                some = pa.array(cells[(_of_line(doc, number) & low).astype(np.int64)] > 0)
                yield pa.RecordBatch.from_arrays([doc, number, flat], [f.name for f in _WORDS]).filter(some)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = jaccard(b.column("wa"), b.column("wb")) >= threshold - _EPS
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in _MATCH], [f.name for f in _MATCH]).filter(pa.array(alike))

    known = cut(df.mapInArrow(words, _WORDS).dropDuplicates(["x", "xl"]))
    end = lambda d, n: known.select(F.col("x").alias(d), F.col("xl").alias(n), F.col("words").alias(f"w{d}"))
    return maybe.join(end("b", "bl"), ["b", "bl"]).join(end("a", "al"), ["a", "al"]).select("b", "bl", "a", "al", "wa", "wb").mapInArrow(verify, _MATCH)


def _first(pairs: DataFrame) -> DataFrame:
    """(b, bl, m): for each line b the first of its partners."""
    return pairs.groupBy("b", "bl").agg(F.min(F.struct("a", "al")).alias("m"))


def removed(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, line, match_id, match_line): each line that an earlier line matches, and the first that does."""
    rows = ship(df).select(whole(id_col).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id is not null")
    pairs = cut(candidates(rows, threshold))
    # Of equal lines the first stands for all: a copy names the first of its chunk, and that the first of all.
    copies = _first(pairs.where("equal").select("b", "bl", "a", "al")).select("b", "bl", F.col("m.a").alias("a"), F.col("m.al").alias("al"))
    origin = copies.select(F.col("b").alias("a"), F.col("bl").alias("al"), F.struct("a", "al").alias("up"))
    copies = copies.join(origin, ["a", "al"], "left").select("b", "bl", F.coalesce("up", F.struct("a", "al")).alias("o"))
    near = _first(_verified(rows, pairs.where("not equal").select("a", "al", "b", "bl"), threshold))
    # What matches the first of the copies, matches them all.
    of_origin = near.select(F.struct(F.col("b").alias("a"), F.col("bl").alias("al")).alias("o"), "m")
    out = copies.join(of_origin, "o", "left").select("b", "bl", F.least("o", F.coalesce("m", "o")).alias("m")).union(near)
    return _least(out).select(F.col("b").alias(id_col), F.col("bl").alias("line"), F.col("m.a").alias("match_id"), F.col("m.al").alias("match_line"))


def _least(matches: DataFrame) -> DataFrame:
    return matches.groupBy("b", "bl").agg(F.min("m").alias("m"))


_WORD = re.compile(r"[0-9A-Za-z]|[^\x00-\x7F]")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """df without the removed lines; documents that lose all their lines with words go.

    The columns are those of df, whatever their names; n_chars is set to the new number of characters
    of the documents that lose lines, where df has a column of that name.
    """
    gone = removed(df, id_col, text, threshold).select(F.col(id_col).alias("id"), "line").groupBy("id").agg(F.collect_set("line").alias("gone"))  # the lines of one document
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), whole(id_col).alias("id"))
    names = df.columns
    at, sized = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("row").flatten()
            lost = b.column("gone")
            hit = np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(b.num_rows, bool)
            if len(hit):
                taken = pa.array(hit)
                new = []
                for old, out in zip(columns[at].take(taken).to_pylist(), lost.take(taken).to_pylist()):
                    out = set(out)
                    # Lines that another row of the same id has may lie beyond this text's end
                    new.append("\n".join([x for i, x in enumerate((old or "").split("\n")) if i not in out]))
                keep[hit] = [bool(_WORD.search(t)) for t in new]
                columns[at] = _replaced(columns[at], hit, new)
                if sized is not None:
                    columns[sized] = _replaced(columns[sized], hit, [len(t) for t in new])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return rows.join(gone, "id", "left").select("row", "gone").mapInArrow(run, df.schema)


def _replaced(column: pa.Array, at: np.ndarray, values: list) -> pa.Array:
    """column with other values at some places."""
    place = np.arange(len(column))
    place[at] = len(column) + np.arange(len(at))
    return pa.concat_arrays([column, pa.array(values).cast(column.type)]).take(pa.array(place))


def sql(threshold: float = THRESHOLD) -> str:
    """The same lines of table documents in SQL: distinct sets are joined under the words of their prefixes."""
    return rf"""
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(s), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'))) AS w FROM s),
k AS (SELECT w, len(w) AS n, min({{'d': doc_id, 'l': line}}) AS o, row_number() OVER (ORDER BY min({{'d': doc_id, 'l': line}})) AS c FROM l WHERE len(w) > 0 GROUP BY w),
t AS (SELECT c, n, unnest(w) AS word FROM k),
f AS (SELECT *, count(*) OVER (PARTITION BY word) AS f FROM t),
r AS (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS place FROM f),
p AS (SELECT c, n, word FROM r WHERE place <= n - ceil({threshold} * n - 1e-9) + 1),
m AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.word = b.word AND a.c < b.c AND a.n >= {threshold} * b.n - 1e-9 AND b.n >= {threshold} * a.n - 1e-9),
v AS (SELECT x.o AS o, m.b AS c, len(list_intersect(x.w, y.w)) AS i, x.n + y.n AS n FROM m JOIN k x ON m.a = x.c JOIN k y ON m.b = y.c),
e AS (SELECT c, o FROM v WHERE i >= ({threshold} - 1e-9) * (n - i) UNION ALL SELECT c, o FROM k UNION ALL
  SELECT m.a, y.o FROM m JOIN k x ON m.a = x.c JOIN k y ON m.b = y.c WHERE len(list_intersect(x.w, y.w)) >= ({threshold} - 1e-9) * (x.n + y.n - len(list_intersect(x.w, y.w))))
SELECT l.doc_id, l.line::INTEGER AS line, min(e.o).d AS match_id, (min(e.o).l)::INTEGER AS match_line FROM l JOIN k ON l.w = k.w JOIN e ON e.c = k.c WHERE e.o < {{'d': l.doc_id, 'l': l.line}} GROUP BY l.doc_id, l.line"""
