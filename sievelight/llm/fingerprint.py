"""Document fingerprints: digests of improbable features.

A feature is a window of a text's UTF-8. Its entropy, in thousandths of the largest, ranks it:
the rarer that entropy is among all windows of the corpus, the better, and of equals the lower.
Windows of little entropy, as of runs of one sign, have no rank. Every span of windows in a row
names the best of them, the leftmost of equals, and a window that is named often enough is a
feature. A Grain says how many bytes, windows and times these are: COARSE, the default, leaves
short texts with few features or none; FINE, of the registered query, makes every span of
windows that lies within a passage name the same feature wherever the passage stands. Each feature, once a document, sets HASHES bits of a Bloom filter of
FILTER_BITS bits; after FEATURES features the next filter of the chain begins. The digest is the
chain, in the order of the text.

Two filters are compared by the bits that they share, beyond what chance would give and as a
share of the most that they could: 0 to 100. Two digests: the mean over the filters of the
shorter one of the highest score against a filter of the other, so a passage is found
within a longer text.

Defined results: null and empty texts, and such of fewer bytes than a window or without any ranked
window, have no features, an empty digest and score 0 against any other. A filter of fewer than LEAST
features, too few for a share, scores 100 where the other has all its bits, else 0. Equal texts have equal digests. The whole of every text counts, once for each row.
All columns pass through; those named as an output column are replaced. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import cut
from .text import chunked, lists, ship, span_hashes, utf8, with_text_columns

WINDOW, SPAN, POPULAR = 64, 64, 16


class Grain(NamedTuple):
    """How features are selected: bytes of a window, a power of two; windows of a span, too; how often a feature is named."""

    window: int
    span: int
    popular: int


COARSE, FINE = Grain(WINDOW, SPAN, POPULAR), Grain(32, 8, 1)
LOWEST = 100  # entropy in thousandths below which a window has no rank
FILTER_BITS, HASHES, FEATURES, LEAST = 2048, 5, 160, 3
#: Share of the way from chance to the most shared bits at which the score begins.
CUTOFF = 0.3
#: Score from which two digests are reported as overlapping.
THRESHOLD = 20.0
_BYTES = FILTER_BITS // 8
_SEGMENT = 1 << 18  # bytes looked at together, for the cache
_SCALE = 1 << 16
_NONE = 1001  # the rank of a window without one

_plogp = np.append(0, np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)))
#: What a byte adds to the sum of c log c when it stands c times already.
_GAIN = np.round(np.diff(_plogp) * _SCALE).astype(np.int32)
_FULL = int(np.log2(WINDOW) * WINDOW * _SCALE)


def entropies(raw: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy of every window of raw, in thousandths of the largest, by its first byte."""
    n = len(raw) - window + 1
    full = int(np.log2(window) * window * _SCALE)
    out = np.zeros(max(n, 0), np.int16)
    for low in range(0, n, _SEGMENT):
        part = raw[low : min(n, low + _SEGMENT) + window - 1]
        size = len(part)
        after, before = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for lag in range(1, window):
            same = (part[lag:] == part[:-lag]).view(np.uint8)
            after[:-lag] += same
            before[lag:] += same
        total = np.empty(size - window + 1, np.int32)
        # The first window byte by byte, each later one from its predecessor.
        total[0] = _GAIN[[int((part[:i] == part[i]).sum()) for i in range(window)]].sum()
        total[1:] = total[0] + np.cumsum(_GAIN[before[window:]] - _GAIN[after[: size - window]], dtype=np.int32)
        out[low : low + len(total)] = (full - total.astype(np.int64)) * 1000 // full
    return out


def _inside(off: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n windows lie within one text."""
    inside = np.ones(n, np.int8)
    edge = off[1:-1]
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(edge - window + 1, 0, n), 1)
    np.add.at(step, np.clip(edge, 0, n), -1)
    inside[np.cumsum(step[:-1]) > 0] = 0
    return inside.astype(bool)


def entropy_counts(column: pa.Array, window: int = WINDOW) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    raw, off = utf8(column)
    e = entropies(raw, window)
    return np.bincount(e[_inside(off, len(e), window)], minlength=1001)[:1001]


_COUNTS = T.StructType([T.StructField("entropy", T.IntegerType()), T.StructField("n", T.LongType())])


def rarity(df: DataFrame, text: str = "text", window: int = WINDOW) -> np.ndarray:
    """Rank of each entropy by its number of windows over all rows of df, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for b in chunked(batches, text):
            total += entropy_counts(b.column(text), window)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], [f.name for f in _COUNTS])

    total = np.zeros(1001, np.int64)
    for r in ship(df).select(F.col(f"`{text}`")).mapInArrow(count, _COUNTS).groupBy("entropy").agg(F.sum("n").alias("n")).collect():  # 1001 rows at most
        total[r["entropy"]] = r["n"]
    return ranks_of(total)


def ranks_of(total: np.ndarray) -> np.ndarray:
    """Ranks from the counts of windows by entropy; entropies that don't occur are the rarest."""
    rank = np.full(1001, _NONE, np.int16)
    rank[LOWEST + np.argsort(total[LOWEST:], kind="stable")] = np.arange(1001 - LOWEST)
    return rank


def features(raw: np.ndarray, off: np.ndarray, rank: np.ndarray, grain: Grain = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the features, in order.

    Runs of windows reach beyond a text's ends, where there are none, so texts don't depend on neighbours.
    """
    window, span, popular = grain
    n = len(raw) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.where(_inside(off, n, window), rank[entropies(raw, window)], np.int16(_NONE))
    starts: list[np.ndarray] = []
    for low in range(0, n, _SEGMENT):
        high = min(n, low + _SEGMENT)
        # Windows whose runs can name one of this segment, and the ends of the texts as windows without rank
        a, b = low - span + 1, high + span - 1
        key = np.full(b - a, _NONE, np.int64)
        key[max(0, -a) : min(n, b) - a] = own[max(0, a) : min(n, b)]
        key = (key << 32) | np.arange(len(key))
        width = 1
        while width < span:  # a power of two: after each turn, the least of `width` from here on
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        named = np.bincount(key & 0xFFFFFFFF, minlength=b - a)[low - a : high - a]
        starts.append(np.flatnonzero((named >= popular) & (own[low:high] < _NONE)) + low)
    start = np.concatenate(starts)
    return np.searchsorted(off, start, "right") - 1, start


def digest_column(column: pa.Array, rank: np.ndarray, grain: Grain = COARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per text, filters per text, filters as rows of bytes) of a chunk of texts."""
    doc, _, value = distinct_features(*utf8(column), rank, grain)
    count = np.bincount(doc, minlength=len(column))
    chain = -(-count // FEATURES)
    row = (np.cumsum(chain) - chain)[doc] + _nth(doc, count) // FEATURES
    bits = np.zeros((int(chain.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[row, ((value >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return count, chain, np.packbits(bits, axis=1)


def _nth(doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The place of each feature in its text."""
    return np.arange(len(doc)) - (np.cumsum(count) - count)[doc]


def distinct_features(raw: np.ndarray, off: np.ndarray, rank: np.ndarray, grain: Grain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of the features, in order, each once a text."""
    doc, start = features(raw, off, rank, grain)
    value = span_hashes(raw, start, start + grain.window, 31)
    order = np.lexsort((start, value, doc))
    again = np.append(False, (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1]))[: len(order)]
    fresh = np.ones(len(order), bool)
    fresh[order[again]] = False
    return doc[fresh], start[fresh], value[fresh]


def _binary(chain: np.ndarray, filters: np.ndarray) -> pa.Array:
    """The digests of a chunk of texts."""
    off = np.append(0, np.cumsum(chain) * _BYTES).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(chain), [None, pa.py_buffer(off), pa.py_buffer(filters)])


def digests(df: DataFrame, rank: np.ndarray, text: str = "text", digest: str = "digest", n_features: str = "n_features", grain: Grain = COARSE) -> DataFrame:
    """df with the digest of each text and its number of features; rank is what `rarity` gives for the grain's window."""
    sent = ship(df).sparkSession.sparkContext.broadcast(rank)  # 1001 numbers
    schema = T.StructType([T.StructField(n_features, T.IntegerType()), T.StructField(digest, T.BinaryType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        count, chain, filters = digest_column(column, sent.value, grain)
        return {n_features: pa.array(count, pa.int32()), digest: _binary(chain, filters)}

    return with_text_columns(df, text, schema, make)


def filter_sizes(count: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Features in each filter of the chains."""
    size = np.full(int(chain.sum()), FEATURES)
    last = np.cumsum(chain)[chain > 0] - 1
    size[last] = (count - (chain - 1) * FEATURES)[chain > 0]
    return size


def overlap_scores(f: np.ndarray, nf: np.ndarray, g: np.ndarray, ng: np.ndarray) -> np.ndarray:
    """Normalised overlap, 0 to 100, of every filter f[i] of nf[i] features with every g[j]."""
    a, b = np.ascontiguousarray(f).view(np.uint64), np.ascontiguousarray(g).view(np.uint64)
    bits_a, bits_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    shared = np.empty((len(a), len(b)), np.float32)
    for j in range(len(b)):
        shared[:, j] = np.bitwise_count(a & b[j]).sum(1, dtype=np.int32)
    most = np.minimum(bits_a[:, None], bits_b[None, :]).astype(np.float32)
    p = (1 - 1 / FILTER_BITS) ** HASHES
    chance = (FILTER_BITS * np.outer(1 - p**nf, 1 - p**ng)).astype(np.float32)
    low = chance + CUTOFF * (most - chance)
    score = np.where((shared > low) & (most > low), 100 * (shared - low) / np.maximum(most - low, 1e-6), 0)
    return np.where(np.minimum.outer(nf, ng) < LEAST, np.where((most > 0) & (shared == most), 100, 0), score)


def compare(count_a: int, a: bytes, count_b: int, b: bytes) -> float:
    """Score of two digests, 0 to 100."""
    left, right = (np.frombuffer(x, np.uint8).reshape(-1, _BYTES) for x in (a, b))
    if not (len(left) and len(right)):
        return 0.0
    nf, ng = (filter_sizes(np.array([c]), np.array([len(x)])) for c, x in ((count_a, left), (count_b, right)))
    s = overlap_scores(left, nf, right, ng)
    return float((s.max(1) if (len(left), count_a) <= (len(right), count_b) else s.max(0)).mean())


def contained(count_a: int, a: bytes, count_b: int, b: bytes) -> float:
    """How much of the text of fewer features the other holds, 0 to 100.

    The mean over its filters, weighted by their features, of the highest score, which counts
    as less against a filter of fewer features, such as the last of a chain.
    """
    (n, x), (m, y) = sorted([(count_a, a), (count_b, b)])
    if not n:
        return 0.0
    few, many = (np.frombuffer(z, np.uint8).reshape(-1, _BYTES) for z in (x, y))
    nf, ng = (filter_sizes(np.array([c]), np.array([len(z)])) for c, z in ((n, few), (m, many)))
    s = overlap_scores(few, nf, many, ng) * np.minimum(1, ng[None, :] / nf[:, None])
    return float((s.max(1) * nf).sum() / n)


def all_scores(count: np.ndarray, chain: np.ndarray, filters: np.ndarray, known: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a known digest, places of the digests with features, their scores), one known digest after the other."""
    own, theirs = filter_sizes(count, chain), filter_sizes(known["count"], known["chain"])
    begin = np.cumsum(known["chain"]) - known["chain"]
    some = np.flatnonzero(chain)
    if not len(some):
        return
    edges = (np.cumsum(chain) - chain)[some]
    for k in np.flatnonzero(known["chain"]):
        part = slice(begin[k], begin[k] + known["chain"][k])
        s = overlap_scores(filters, own, known["filters"][part], theirs[part])
        shorter = (chain[some] < known["chain"][k]) | ((chain[some] == known["chain"][k]) & (count[some] <= known["count"][k]))
        yield k, some, np.where(shorter, np.add.reduceat(s.max(1), edges) / chain[some], np.maximum.reduceat(s, edges, axis=0).mean(1))


def best_matches(count: np.ndarray, chain: np.ndarray, filters: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place among the known digests or -1, score) of the best match of each digest, of equals the first; (digest, place, score) of all from THRESHOLD."""
    best, at = np.zeros(len(count), np.float32), np.full(len(count), -1)
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for k, some, here in all_scores(count, chain, filters, known):
        more = here > best[some]
        best[some[more]], at[some[more]] = here[more], k
        here = np.round(here.astype(np.float64), 3)
        hit = np.flatnonzero(here >= THRESHOLD)
        found.append((some[hit], np.full(len(hit), k), here[hit]))
    return at, best, [np.concatenate(x) for x in zip(*found)]


#: Bytes of digests that are broadcast to be compared with; what is beyond goes in further turns.
KNOWN_BYTES = 8 << 20


def match(df: DataFrame, known: DataFrame, known_id: str = "item_id", digest: str = "digest", n_features: str = "n_features", out_id: str = "match_id", score: str = "score", matches: str = "matches") -> DataFrame:
    """df, of digests, with the best of the digests in `known` and its score; null and 0 where none scores.

    Column `matches` lists (id, score) of all that score THRESHOLD or more, the highest first, of equals the least id.

    known holds the same digest columns. It is checked to be KNOWN_BYTES at most, else it is cut by
    hashed id, and df is compared with one part after the other.
    """
    rows = known.select(F.col(f"`{known_id}`").cast("bigint").alias("id"), F.col(n_features).alias("n"), F.col(digest).alias("d")).where("id is not null and length(d) > 0")
    size = rows.agg(F.sum(F.length("d"))).first()[0] or 0
    turns = max(1, -(-size // KNOWN_BYTES))
    new = {out_id.lower(), score.lower(), matches.lower()}
    out = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in new]).withColumns({out_id: F.lit(None).cast("bigint"), score: F.lit(0.0), matches: F.expr("cast(array() as array<struct<id: bigint, score: double>>)")})
    for turn in range(turns):
        got = sorted(rows.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).collect(), key=lambda r: r.id)  # about KNOWN_BYTES
        table = {"id": np.array([r.id for r in got], np.int64), "count": np.array([r.n for r in got], np.int64), "chain": np.array([len(r.d) // _BYTES for r in got], np.int64), "filters": np.frombuffer(b"".join(bytes(r.d) for r in got), np.uint8).reshape(-1, _BYTES)}
        sent = df.sparkSession.sparkContext.broadcast(table)
        at_id, at_score, at_all = (out.columns.index(c) for c in (out_id, score, matches))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at_id=at_id, at_score=at_score, at_all=at_all) -> Iterator[pa.RecordBatch]:
            for b in chunked(batches, digest, 1 << 20):
                raw, off = utf8(b.column(digest))
                place, s, (hit, which, high) = best_matches(b.column(n_features).to_numpy().astype(np.int64), np.diff(off) // _BYTES, raw.reshape(-1, _BYTES), sent.value)
                old, old_id = b.column(at_score).to_numpy(), b.column(at_id)
                ids = pa.array(np.append(sent.value["id"], 0)[place], pa.int64(), mask=place < 0)
                s = np.round(s.astype(np.float64), 3)
                better = pa.array((s > old) | ((s == old) & (s > 0) & (np.append(sent.value["id"], 0)[place] < old_id.fill_null(2**63 - 1).to_numpy())))
                columns = list(b.columns)
                columns[at_id], columns[at_score] = pc.if_else(better, ids, old_id), pc.if_else(better, pa.array(s), pa.array(old))
                # Those of earlier turns, then of this one, by document
                before = b.column(at_all)
                had = pc.list_value_length(before).to_numpy()
                doc = np.concatenate([np.repeat(np.arange(len(had)), had), hit])
                was = before.flatten()
                all_ids = np.concatenate([was.field(0).to_numpy(zero_copy_only=False), sent.value["id"][which]])
                every = np.concatenate([was.field(1).to_numpy(zero_copy_only=False), high])
                order = np.lexsort((all_ids, -every, doc))
                pairs = pa.StructArray.from_arrays([pa.array(all_ids[order], pa.int64()), pa.array(every[order], pa.float64())], ["id", "score"])
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(had)))).astype(np.int32)
                columns[at_all] = pa.ListArray.from_arrays(pa.array(ends), pairs)
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


#: Windows of the wider spans that choose, among the features of a digest, those that name candidates.
CANDIDATE_SPAN = 64
#: One in so many of a filter's candidate features, the commonest, isn't looked up; all are indexed.
COMMONEST = 8


def with_candidates(df: DataFrame, rank: np.ndarray, text: str, grain: Grain) -> DataFrame:
    """df with n_features, digest and `named`: of each filter, those of its features that name candidates."""
    sent = ship(df).sparkSession.sparkContext.broadcast(rank)  # 1001 numbers
    schema = T.StructType([T.StructField("n_features", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("named", T.ArrayType(T.ArrayType(T.LongType())))])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        raw, off = utf8(column)
        doc, start, value = distinct_features(raw, off, sent.value, grain)
        count, chain, filters = digest_column(column, sent.value, grain)
        row = (np.cumsum(chain) - chain)[doc] + _nth(doc, count) // FEATURES
        wide = np.isin(start, features(raw, off, sent.value, grain._replace(span=CANDIDATE_SPAN))[1])
        inner = lists(value[wide].view(np.int64), np.bincount(row[wide], minlength=int(chain.sum())), pa.int64())
        ends = np.append(0, np.cumsum(chain)).astype(np.int32)
        return {"n_features": pa.array(count, pa.int32()), "digest": _binary(chain, filters), "named": pa.ListArray.from_arrays(pa.array(ends), inner)}

    return with_text_columns(df, text, schema, make)


def candidates(heads: DataFrame) -> DataFrame:
    """Pairs a < b of the ids of heads (id, named) that share a feature which isn't among the commonest of either's filter."""
    filters = heads.select("id", F.posexplode("named").alias("g", "own"))
    rows = filters.select("id", "g", F.size("own").alias("m"), F.explode("own").alias("f"))
    shared = cut(rows.withColumn("n", F.count("*").over(Window.partitionBy("f"))).where("n > 1"))
    common = F.row_number().over(Window.partitionBy("id", "g").orderBy(F.desc("n"), "f"))
    asked = shared.withColumn("k", common).where(f"k > m div {COMMONEST}").select("f", F.col("id").alias("a"))
    met = asked.join(shared.select("f", F.col("id").alias("b")), "f").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("score", T.DoubleType())])


def pairs(df: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text: str = "text", grain: Grain = FINE) -> DataFrame:
    """(a, b, score): the documents a < b of which one is `contained` in the other by THRESHOLD or more.

    Of documents with equal digests, which score 100, only the one of least id is compared
    further; each other has one row, with that one, so every overlap follows from the rows.
    Rows of equal id count as one document, which scores as its best row; null ids and texts
    without features are in no pair.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    made = digests(docs, rank, grain=grain).where("n_features > 0")
    equal = Window.partitionBy("n_features", "h")
    alike = made.select("id", "n_features", F.sha2("digest", 256).alias("h")).withColumn("head", F.min("id").over(equal))
    copies = alike.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("score"))
    named = with_candidates(docs, rank, "text", grain).where("n_features > 0").select("id", "n_features", F.sha2("digest", 256).alias("h"), "named")
    heads = named.withColumn("k", F.row_number().over(equal.orderBy("id"))).where("k = 1").select("id", "named")
    found = cut(candidates(heads))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, m, e = (b.column(c).to_pylist() for c in ("na", "da", "nb", "db"))
            s = np.round([contained(*x) for x in zip(n, d, m, e)], 3)
            high = pa.array(s >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], [f.name for f in _PAIR]).filter(high)

    side = lambda c: made.select(F.col("id").alias(c), F.col("n_features").alias(f"n{c}"), F.col("digest").alias(f"d{c}"))
    scored = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "da", "nb", "db").mapInArrow(score, _PAIR)
    return copies.union(scored).groupBy("a", "b").agg(F.max("score").alias("score"))
