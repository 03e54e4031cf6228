"""SimHash near-duplicates through an LSH forest.

A document's signature is 256 bits: the signs of a random projection of its words, each
weighted by (1 + ln tf) * idf, idf being taken from the frequencies over all documents.
Several tries hold the signatures, each over its own random order of the bits. Documents
that share a trie's node are compared in full. The depth of the nodes starts where the density of
the signatures puts only a few into each, and climbs to shorter prefixes until two conditions
hold: by formula, `recall` of the pairs at the largest distance meet in some trie; and by
measurement, as many of the true pairs do that a bounded sample of SAMPLE signatures has among
all signatures, found by brute force. Where a node is sparse it stays at a shorter prefix still.
Pairs within `distance` bits whose counts of distinct words differ by less than half are
near-duplicates, and groups are the connected components of these pairs.

Signatures go through the shuffle as packed arrays (module exchange), one part of a trie at a time
being held. Parts begin at a short prefix; where that is dense, at the node itself. Equal
signatures are one entry of the tries, however many there are. A node passes on only the links
that hold its groups together, and in a dense node what is linked already isn't compared again:
work there follows the size of the node times the number of its members outside its largest group.

Defined results: texts without words, null and empty ones among them, are near-duplicates only
of texts that are equal byte by byte. Rows with the same id are one document. Rows whose id is
null or no whole number are in no group and stay. Case, punctuation and the order of words don't
count. An empty table gives no groups. Columns other than id and text are neither read nor
touched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .graph import components, cut
from .exchange import ROW, Packer, blocks, exchanged, parts_of, unpack
from .text import chunked, lower, mix64, ship, span_hashes, utf8, whole, without, word_spans

BITS = 256
#: Largest Hamming distance of near-duplicates: signatures 17 % apart, a cosine of about 0.86.
DISTANCE = 44
#: Share of the pairs at that distance which the tries find; nearer pairs are found more often.
RECALL = 0.95
_CELLS = 4096  # signed cells that words fall into before the projection
#: Signatures whose true pairs are found by brute force to measure the recall; those of least hashed id.
SAMPLE = 256
_LEAF = 32  # a node of so few signatures isn't split further
_DENSE = 256  # a node of more is looked at anew when neighbours have been linked
_BUCKET = 1 << 15  # signatures in a part of a trie, on average
_DOCS = 1024  # documents projected at once


def word_weights(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, tf) of the distinct words of each text, by document."""
    raw, off = utf8(lower(column))
    start, end = word_spans(raw, off, True)
    word = span_hashes(raw, start, end)
    doc = np.searchsorted(off, start, "right") - 1
    order = np.argsort(word, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    word, doc = word[order], doc[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))) if len(word) else np.zeros(0, np.int64)
    return doc[first], word[first], np.diff(np.append(first, len(word)))


def document_words(column: pa.Array) -> np.ndarray:
    return word_weights(column)[1]


_projection: dict[int, np.ndarray] = {}


def signatures_of(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as rows of 32 bytes, distinct words) of a chunk of texts."""
    if BITS not in _projection:
        _projection[BITS] = (np.random.Generator(np.random.PCG64(5)).integers(0, 2, (_CELLS, BITS)) * 2 - 1).astype(np.float32)
    n = len(column)
    doc, word, tf = word_weights(column)
    weight = (1 + np.log(tf)) * idf[(word & np.uint64(len(idf) - 1)).astype(np.int64)]
    spread = mix64(word + np.uint64(77))
    cell = (spread & np.uint64(_CELLS - 1)).astype(np.int64)
    weight *= 1 - 2 * ((spread >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
    out = np.zeros((n, BITS // 8), np.uint8)
    for a in range(0, n, _DOCS):
        b = min(n, a + _DOCS)
        i, j = np.searchsorted(doc, [a, b])
        grid = np.bincount((doc[i:j] - a) * _CELLS + cell[i:j], weights=weight[i:j], minlength=(b - a) * _CELLS)
        out[a:b] = np.packbits(grid.reshape(b - a, _CELLS).astype(np.float32) @ _projection[BITS] > 0, axis=1)
    words = np.bincount(doc, minlength=n)
    bare = np.flatnonzero(words == 0)
    if len(bare):  # no words: bits of a hash of the text, so that only equal texts agree
        raw, off = utf8(column)
        whole = np.stack([span_hashes(raw, off[bare], off[bare + 1], 20 + k) for k in range(BITS // 64)], axis=1)
        out[bare] = whole.view(np.uint8).reshape(len(bare), BITS // 8)
    return out, words


def plan(n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """(tries, depth): the cheapest for n signatures that finds `recall` of pairs at `distance`."""
    best = None
    for tries in range(4, 513, 4):
        meet = 1 - (1 - recall) ** (1 / tries)
        depth = min(60, int(math.log(meet) / math.log(1 - (distance + 0.5) / BITS)))
        if depth < 1:
            continue
        cost = tries * n * (1500 + 12 * n / 2**depth / 2)
        if best is None or cost < best[0]:
            best = cost, tries, depth
    return best[1], best[2]


def trie_keys(signature: np.ndarray, trie: int) -> np.ndarray:
    """The first 64 bits of each signature in the order of trie number `trie`, as integers."""
    order = np.random.Generator(np.random.PCG64([trie, 9])).permutation(BITS)[:64]
    bits = np.packbits(np.unpackbits(signature, axis=1)[:, order], axis=1)
    return np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins a[i] with b[i] in a forest of least indices."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _roots(parent)
    return parent


def _near(sig: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that are near-duplicates."""
    near = np.bitwise_count(sig[i, :2] ^ sig[j, :2]).sum(1, dtype=np.int64) <= distance
    i, j = i[near], j[near]
    near = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64) <= distance
    near &= 2 * np.minimum(count[i], count[j]) >= np.maximum(count[i], count[j])
    return i[near], j[near]


def node_links(signature: np.ndarray, words: np.ndarray, key: np.ndarray, prefix: int, depth: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that hold the groups of near-duplicates within the nodes of a trie's part.

    All keys share their first `prefix` bits or none; nodes are split down to `depth`.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    key, sig, count = key[order], np.ascontiguousarray(signature[order]).view(np.uint64), words[order]
    begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)
    for at in range(prefix, depth + 1):
        short = key[todo] >> np.uint64(64 - at) if at else np.zeros(len(todo), np.uint64)
        first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        size = np.diff(np.append(first, len(todo)))
        done = np.repeat((size <= _LEAF) | (at == depth), size)
        begin[todo[done]] = np.repeat(todo[first], size)[done]
        end[todo[done]] = np.repeat(todo[first] + size, size)[done]
        todo = todo[~done]
        if not len(todo):
            break
    parent, live, step = np.arange(n), np.arange(n), 1
    big = end - begin > _DENSE
    while True:
        # Neighbours in the order of the keys first; in dense nodes only as many as a small node has
        live = live[(end[live] > live + step) & (~big[live] | (step <= _LEAF))]
        if not len(live):
            break
        for lo in range(0, len(live), 1 << 18):
            i = live[lo : lo + (1 << 18)]
            i, j = _near(sig, count, i, i + step, distance)
            parent = link(parent, i, j)
        step += 1
    for node in np.unique(begin[big]):
        parent = _dense_node(sig, count, parent, int(node), int(end[node]), distance)
    hang = np.flatnonzero(parent != np.arange(n))
    return order[hang], order[parent[hang]]


def _dense_node(sig: np.ndarray, count: np.ndarray, parent: np.ndarray, lo: int, hi: int, distance: int) -> np.ndarray:
    """Links all that is near in the node lo:hi, comparing nothing that hangs together already.

    Each member outside the largest group is compared with all members of other groups.
    """
    inside = np.arange(lo, hi)
    roots, size = np.unique(parent[inside], return_counts=True)
    largest = roots[size.argmax()]
    for i in inside[parent[inside] != largest]:
        if parent[i] == parent[largest]:
            continue  # what it could still link is outside, and gets compared with it
        j = inside[parent[inside] != parent[i]]
        parent = link(parent, *_near(sig, count, np.full(len(j), i), j, distance))
    return parent


_SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("words", T.IntegerType())])
_ENTRY = [("id", np.int64), ("sig", np.dtype((np.void, BITS // 8))), ("words", np.int32)]
_HEAD = T.StructType([T.StructField("trie", T.IntegerType()), T.StructField("head", T.LongType()), T.StructField("n", T.LongType())])
_MET = T.StructType([T.StructField("trie", T.IntegerType()), T.StructField("n", T.LongType())])
_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def signatures(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sig, words) of every row whose id isn't null."""
    rows = ship(df).select(whole(id_col).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id is not null")
    counts = sketch.frequencies(rows, "text", document_words).astype(np.float64)
    n = rows.count()
    idf = df.sparkSession.sparkContext.broadcast(np.maximum(np.log((n + 1) / (counts + 1)), 1e-3).astype(np.float32))  # 4 MB for any corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunked(batches, "text"):
            sig, words = signatures_of(b.column("text"), idf.value)
            flat = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(len(sig) + 1, dtype=np.int32) * (BITS // 8)), pa.py_buffer(sig)])
            yield pa.RecordBatch.from_arrays([b.column("id"), flat, pa.array(words, pa.int32())], [f.name for f in _SIGNED])

    return rows.mapInArrow(run, _SIGNED)


def _matrix(column: pa.Array) -> np.ndarray:
    raw, _ = utf8(column)
    return raw.reshape(-1, BITS // 8)


def measured(distinct: DataFrame, tries: int, deepest: int, distance: int) -> tuple[int, np.ndarray]:
    """(true pairs, pairs that meet by depth 0..deepest) of a sample of SAMPLE signatures with all others.

    The sample is compared with every signature by brute force; only counts leave the tasks.
    """
    order = distinct.select("id", "sig", "words").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE rows
    if not order:
        return 0, np.zeros(deepest + 1)
    own = np.frombuffer(b"".join(bytes(r.sig) for r in order), np.uint8).reshape(-1, BITS // 8)
    sent = distinct.sparkSession.sparkContext.broadcast((own, np.array([r.words for r in order]), np.array([r.id for r in order])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, words, ids = sent.value
        mine = np.ascontiguousarray(sig).view(np.uint64)
        total = np.zeros(65, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            theirs, n, other = _matrix(b.column("sig")), b.column("words").to_numpy(), b.column("id").to_numpy()
            flat = np.ascontiguousarray(theirs).view(np.uint64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(len(mine)):
                at = np.flatnonzero(np.bitwise_count(flat ^ mine[k]).sum(1, dtype=np.int64) <= distance)
                at = at[(2 * np.minimum(n[at], words[k]) >= np.maximum(n[at], words[k])) & (other[at] != ids[k])]
                found.append((np.full(len(at), k), at))
            i, j = (np.concatenate(x) for x in zip(*found))
            for lo in range(0, len(i), 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                meet = np.zeros(len(p), np.int64)
                for trie in range(tries):
                    apart = trie_keys(sig[p] ^ theirs[q], trie)
                    # The bits of the longest common prefix: those before the first that differs
                    meet = np.maximum(meet, np.where(apart == 0, 64, 63 - np.floor(np.log2(np.maximum(apart, np.uint64(1)).astype(np.float64))).astype(np.int64)))
                total += np.bincount(np.minimum(meet, 64), minlength=65)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], [f.name for f in _MET])

    total = np.zeros(65)
    for r in distinct.mapInArrow(count, _MET).groupBy("trie").agg(F.sum("n").alias("n")).collect():  # 65 rows at most
        total[r["trie"]] = r["n"]
    upto = np.cumsum(total[::-1])[::-1]
    return int(total.sum()), upto[: deepest + 1]


def climb(distinct: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int, float | None]:
    """(tries, depth, measured recall at that depth, None without a true pair in the sample)."""
    tries, depth = plan(max(n, 2), distance, recall)
    pairs, upto = measured(distinct, tries, depth, distance)
    while pairs and depth > 0 and upto[depth] < recall * pairs:
        depth -= 1
    return tries, depth, float(upto[depth] / pairs) if pairs else None


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that hold together the near-duplicates among n rows (id, sig, words)."""
    tries, depth, _ = climb(distinct, n, distance, recall)
    prefix = min(depth, max(0, math.ceil(math.log2(max(n, 1) / _BUCKET))))
    parts = parts_of(distinct)

    def heads(sig: np.ndarray, trie: int, bits: int) -> np.ndarray:
        return (trie_keys(sig, trie) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column("sig"))
            for trie in range(tries):
                head, many = np.unique(heads(sig, trie, prefix), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), trie, np.int32)), pa.array(head), pa.array(many.astype(np.int64))], [f.name for f in _HEAD])

    # Dense beginnings, of which n * tries / (8 * _BUCKET) are possible at most: their parts are single nodes
    counted = distinct.mapInArrow(count, _HEAD).groupBy("trie", "head").agg(F.sum("n").alias("n")).where(F.col("n") > 8 * _BUCKET)
    dense = distinct.sparkSession.sparkContext.broadcast({t: np.sort(np.array(h, np.int64)) for t, h in _by_trie(counted).items()} if prefix < depth and n > 8 * _BUCKET else {})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Packer(_ENTRY)
        for b in batches:
            if not b.num_rows:
                continue
            ids, sig, words = b.column("id").to_numpy(), np.ascontiguousarray(_matrix(b.column("sig"))), b.column("words").to_numpy()
            whole_rows = sig.view(_ENTRY[1][1]).ravel()
            for trie in range(tries):
                head = heads(sig, trie, prefix)
                part = (trie << prefix) + head
                if trie in dense.value:
                    deep = np.isin(head, dense.value[trie])
                    # A node's number, negative so that it is no beginning's
                    part = np.where(deep, -1 - ((trie << depth) + heads(sig, trie, depth)), part)
                yield from entries.add(part, [ids, whole_rows, words])
        yield from entries.rest()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, data in blocks(batches):
            ids, sig, words = unpack(data, _ENTRY)
            sig = sig.view(np.uint8).reshape(-1, BITS // 8)
            known, trie = (depth, (-1 - part) >> depth) if part < 0 else (prefix, part >> prefix)
            i, j = node_links(sig, words, trie_keys(sig, trie), known, depth, distance)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64())], ["a", "b"])

    return exchanged(distinct.mapInArrow(spread, ROW), parts).mapInArrow(search, _EDGES)


def _by_trie(counted: DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in counted.select("trie", "head").collect():
        out.setdefault(r["trie"], []).append(r["head"])
    return out


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """(id_col, keep_id) for every document that has a near-duplicate of lower id: keep_id is its group's least id."""
    signed = cut(signatures(df, id_col, text))
    equal = signed.groupBy("sig", "words").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    distinct = cut(equal.select(F.col("first").alias("id"), "sig", "words"))
    near = links(distinct, distinct.count(), distance, recall)
    same = signed.join(equal.where("first <> last"), ["sig", "words"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    return components(near.union(same)).where("node <> root").select(F.col("node").alias(id_col), F.col("root").alias("keep_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """df without the documents that have a near-duplicate of lower id in their group."""
    return without(df, groups(df, id_col, text, distance, recall).select(F.col(id_col).alias("id")), id_col)
