"""Byte-pair encoding, decoding and token counts over a rank file.

Pre-tokens are cut by the published pattern of the byte-level vocabularies (contractions,
letters, numbers, other signs, white space), here as array operations over a chunk of
texts. Each distinct pre-token is then merged with a segment tree whose leaves hold the
rank of the pair that starts at a symbol: the root gives the leftmost pair of least rank,
a merge changes three leaves and their ancestors, and the end is reached when the root
holds no pair. Short pre-tokens go through many trees side by side in numpy, long ones
through one tree each, so that a text without any white space still costs n log n.

Defined results: null and empty texts have no tokens; every other text, whatever its
characters, decodes to itself; repeated rows are encoded alike; an empty table gives an
empty one. Columns of the input pass through, and one with the name of an output column
is replaced.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunked, lists, ranges, ship, span_hashes, utf8, with_text_columns

#: Where the public rank files lie; any file in tiktoken's format will do.
RANKS = os.environ.get("SIEVELIGHT_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_NONE = np.int32(2**31 - 1)
#: Longest pre-token, in bytes, that is merged side by side with others.
SIDE_BY_SIDE = 64


# ---------------------------------------------------------------- pre-tokens


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 3 white space, 0 any other."""
    kind = {"L": 1, "N": 2}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return table


def pretoken_offsets(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens of the texts raw[off[i]:off[i+1]] begin, and the end."""
    if not len(raw):
        return np.zeros(1, np.int64)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(cp)
    doc = np.searchsorted(lead, off[:-1][off[:-1] < len(raw)])
    cls = char_classes()[cp]
    fresh = np.zeros(n + 4, bool)  # the first character of a text
    fresh[doc] = True
    fresh[n:] = True
    run = fresh[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    run[0] = True
    white = cls == 3
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (cp[:-1] == 32) & ~fresh[1:n]
    start = run & (white | ~after_blank)
    # The last of a run of white space that text follows goes with that text, or stands alone.
    start[:-1] |= white[:-1] & ~white[1:] & ~fresh[1:n]
    start = np.concatenate([start, np.ones(4, bool)])
    # Contractions: an apostrophe where a pre-token begins, then letters.
    quote = np.flatnonzero((cp == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    a = cp[quote + 1]
    two = np.isin(a, [ord(c) for c in "stmd"])
    b = cp[np.minimum(quote + 2, n - 1)]
    three = ~fresh[quote + 2] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
    for at, size in ((quote[two], 2), (quote[three], 3)):
        start[at + 1] = False
        if size == 3:
            start[at + 2] = False
        start[at + size] = True
    return np.append(lead[np.flatnonzero(start[:n])], len(raw))


# ---------------------------------------------------------------- vocabulary


class Vocabulary:
    """Token bytes, and the rank of every pair of tokens that may merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.values = np.append(np.array(values, np.int32)[order], _NONE)
        self.pair = dict(zip(keys, values))
        self.arrow = pa.array(self.tokens, pa.binary())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where they never merge; an id below 0 is no symbol."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _NONE)


@lru_cache(4)
def vocabulary(path: str = RANKS) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- merging


def merge_one(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Merges one sequence of ids with a segment tree over its adjacent pairs."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    ids, pair, size = list(symbols), vocab.pair, vocab.size
    width = 1 << (n - 1).bit_length()
    free = 1 << 62
    tree = [free] * (2 * width)

    def leaf(i: int, j: int) -> int:
        rank = pair.get(ids[i] * size + ids[j])
        return free if rank is None else rank * width + i

    tree[width : width + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] != free:
        rank, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        ids[i], ids[j] = rank, -1
        after[i] = k
        put(j, free)
        if k < n:
            before[k] = i
            put(i, leaf(i, k))
        else:
            put(i, free)
        if before[i] >= 0:
            put(before[i], leaf(before[i], i))
    return [x for x in ids if x >= 0]


def merge_many(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merges every row of ids (-1 after a row's end) at once, in place; -1 marks what went.

    Row r has its own segment tree in tree[r]: leaf width+i is rank*width+i of the pair at
    symbol i, node k the least of nodes 2k and 2k+1.
    """
    n, width = ids.shape
    bits = width.bit_length() - 1
    tree = np.full((n, 2 * width), _NONE, np.int32)
    rank = vocab.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width : 2 * width - 1] = np.where(rank == _NONE, _NONE, rank * np.int32(width) + np.arange(width - 1, dtype=np.int32))
    at = width
    while at > 1:
        np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at // 2 : at])
        at //= 2
    after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
    ids_, tree_, after_, before_ = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()
    row = np.arange(n)

    def get(flat: np.ndarray, base: np.ndarray, i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < width)
        return np.where(inside, flat[base + np.where(inside, i, 0)], -1)

    def put(base: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        base = base * 2
        node = i + width
        tree_[base + node] = value
        for _ in range(bits):
            node = node >> 1
            child = base + 2 * node
            tree_[base + node] = np.minimum(tree_[child], tree_[child + 1])

    while True:
        root = tree_[row * (2 * width) + 1]
        live = root != _NONE
        if not live.all():
            row, root = row[live], root[live]
        if not len(row):
            return ids
        base = row * width
        i = root & (width - 1)
        merged = root >> bits
        j = after_[base + i]
        k = after_[base + j]
        ids_[base + i] = merged
        ids_[base + j] = -1
        after_[base + i] = k
        inside = k < width
        before_[base[inside] + k[inside]] = i[inside]
        put(base, j, np.full(len(row), _NONE, np.int32))
        follower = get(ids_, base, k)
        rank = vocab.pair_ranks(merged, follower)
        put(base, i, np.where(rank == _NONE, _NONE, rank * np.int32(width) + i.astype(np.int32)))
        p = before_[base + i]
        has = p >= 0
        if has.any():
            base, p, merged = base[has], p[has], merged[has]
            rank = vocab.pair_ranks(ids_[base + p], merged)
            put(base, p, np.where(rank == _NONE, _NONE, rank * np.int32(width) + p.astype(np.int32)))


def encode_pieces(raw: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids per piece) of pre-tokens raw[off[i]:off[i+1]]."""
    size = np.diff(off)
    count = np.zeros(len(size), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which pieces, flat ids, counts
    width = 1
    while width <= SIDE_BY_SIDE:
        which = np.flatnonzero((size > width // 2) & (size <= width))
        step = max(1, (1 << 20) // width)
        for lo in range(0, len(which), step):
            w = which[lo : lo + step]
            grid = np.arange(width)[None, :]
            inside = grid < size[w][:, None]
            ids = np.where(inside, vocab.of_byte[raw[np.minimum(off[w][:, None] + grid, len(raw) - 1)]], -1).astype(np.int32)
            if width > 1:
                merge_many(ids, vocab)
            keep = ids >= 0
            parts.append((w, ids[keep], keep.sum(1)))
        width *= 2
    for w in np.flatnonzero(size > SIDE_BY_SIDE):
        ids = np.array(merge_one(vocab.of_byte[raw[off[w] : off[w + 1]]].tolist(), vocab), np.int32)
        parts.append((np.array([w]), ids, np.array([len(ids)])))
    for w, _, c in parts:
        count[w] = c
    out_off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(count, out=out_off[1:])
    flat = np.empty(out_off[-1], np.int32)
    for w, ids, c in parts:
        flat[np.repeat(out_off[w], c) + ranges(c)] = ids
    return flat, count


def binary_slices(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    """raw[off[i]:off[i+1]] as a binary array, without a copy of the bytes."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def encode_column(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids per text)."""
    raw, off = utf8(column)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    cut = pretoken_offsets(raw, off)
    coded = binary_slices(raw, cut).dictionary_encode()
    which = coded.indices.to_numpy()
    flat, count = encode_pieces(*utf8(coded.dictionary), vocab)
    starts = np.cumsum(count) - count
    n = count[which]
    ids = flat[np.repeat(starts[which], n) + ranges(n)]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    return ids, np.diff(ends[np.searchsorted(cut, off)])


def decode_column(column: pa.Array, vocab: Vocabulary) -> pa.Array:
    """Lists of ids as strings; bytes that are no UTF-8 become U+FFFD."""
    flat = column.flatten()
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, off = utf8(vocab.arrow.take(flat.cast(pa.int32())))
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    cut = off[ends] if len(off) > 1 else np.zeros(len(ends), np.int64)
    joined = binary_slices(raw, cut)
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


# ---------------------------------------------------------------- DataFrames


def encode(df: DataFrame, text: str = "text", ranks: str = RANKS, token_ids: str = "token_ids", n_tokens: str = "n_tokens") -> DataFrame:
    """df with token_ids (array<int>) and n_tokens; one narrow pass, no shuffle."""
    schema = T.StructType([T.StructField(token_ids, T.ArrayType(T.IntegerType(), False)), T.StructField(n_tokens, T.LongType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        ids, n = encode_column(column, vocabulary(ranks))
        return {token_ids: lists(ids, n, pa.int32()), n_tokens: pa.array(n, pa.int64())}

    return with_text_columns(ship(df), text, schema, make)


def decode(df: DataFrame, token_ids: str = "token_ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """df with the text of its token ids; null or empty lists give ''."""
    ship(df)
    kept = [f for f in df.schema if f.name.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [decode_column(b.column(token_ids), vocabulary(ranks))], [f.name for f in kept] + [out])

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def round_trip(df: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """df with token_ids, n_tokens and round_trip: whether the ids, decoded, are the text again."""
    schema = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        vocab = vocabulary(ranks)
        ids, n = encode_column(column, vocab)
        coded = lists(ids, n, pa.int32())
        same = pc.equal(decode_column(coded, vocab), column.fill_null("").cast(pa.string()))
        return {"token_ids": coded, "n_tokens": pa.array(n, pa.int64()), "round_trip": same}

    return with_text_columns(ship(df), text, schema, make)


# ---------------------------------------------------------------- token counts


class LengthTable:
    """A compact hash table from pre-token bytes to token counts: open addressing in numpy.

    Keys are 128 bits of hash, so no bytes are kept; growth doubles the slots.
    """

    def __init__(self, slots: int = 1 << 10):
        self.n = 0
        self.key = np.zeros(slots, np.uint64)
        self.check = np.zeros(slots, np.uint64)
        self.value = np.zeros(slots, np.int32)  # 0: free; every pre-token has a token at least

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(len(self.key) - 1)).astype(np.int64)

    def get(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Token counts, 0 where a key is missing."""
        out = np.zeros(len(key), np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            used = self.value[slot] != 0
            todo, slot = todo[used], slot[used]
            hit = (self.key[slot] == key[todo]) & (self.check[slot] == check[todo])
            out[todo[hit]] = self.value[slot[hit]]
            todo, slot = todo[~hit], (slot[~hit] + 1) & (len(self.key) - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that are distinct and missing."""
        if 2 * (self.n + len(key)) > len(self.key):
            used = self.value != 0
            old = self.key[used], self.check[used], self.value[used]
            slots = 1 << int(4 * (self.n + len(key))).bit_length()
            self.__init__(slots)
            self.add(*old)
        self.n += len(key)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.value[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            winner = np.flatnonzero(free)[first]
            self.key[taken], self.check[taken], self.value[taken] = key[todo[winner]], check[todo[winner]], value[todo[winner]]
            rest = np.ones(len(todo), bool)
            rest[winner] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (len(self.key) - 1)


#: Pre-tokens in the broadcast table, and in what a task reports of its own.
FREQUENT = 1 << 16
#: Distinct pre-tokens a task counts before it drops the rarest half.
COUNTED = 1 << 20
#: Entries of a worker's cache before it starts afresh.
CACHED = 1 << 21


def _merge_counts(key: np.ndarray, value: np.ndarray, rows: list[np.ndarray], most: int) -> tuple:
    """Sums value by key (first of rows goes along) and keeps the `most` largest, ties by key."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, first) if len(key) else value
    key, rows = key[first], [r[order][first] for r in rows]
    if len(key) > most:
        top = np.sort(np.lexsort((key, -total))[:most])
        key, total, rows = key[top], total[top], [r[top] for r in rows]
    return key, total, rows


def _pretoken_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    raw, off = utf8(column)
    cut = pretoken_offsets(raw, off)
    coded = binary_slices(raw, cut).dictionary_encode() if len(raw) else pa.array([], pa.binary()).dictionary_encode()
    r, o = utf8(coded.dictionary)
    return span_hashes(r, o[:-1], o[1:], 11), span_hashes(r, o[:-1], o[1:], 12), coded.indices.to_numpy(), coded.dictionary, off, cut


_SUMMARY = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("checks", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _summary_row(part: int, key: np.ndarray, total: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (key, rows[0], rows[1], total)]], [f.name for f in _SUMMARY])


def frequent_lengths(df: DataFrame, text: str = "text", ranks: str = RANKS, frequent: int = FREQUENT) -> dict[str, np.ndarray]:
    """The most frequent pre-tokens of the whole table with their token counts.

    Each task counts the pre-tokens of all its texts and reports its `frequent` largest in one
    row; the rows, of bounded size, are summed in a tree of tasks, 32 to a node. Pre-tokens
    themselves never take part in a shuffle. The result is of fixed size and only says which
    lengths are known in advance, so counts don't depend on it.
    """
    ship(df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = check = np.zeros(0, np.uint64)
        total, pieces = np.zeros(0, np.int64), pa.array([], pa.binary())
        held: list[tuple] = []
        size = 0

        def settle(most: int) -> None:
            nonlocal key, check, total, pieces, size
            at = np.concatenate([np.arange(len(key)), *[np.arange(len(h[0])) for h in held]]) if held else np.arange(len(key))
            where = np.repeat(np.arange(len(held) + 1), [len(key), *[len(h[0]) for h in held]])
            every = pa.chunked_array([pieces, *[h[3] for h in held]], pa.binary())
            base = np.cumsum([0, len(key), *[len(h[0]) for h in held]])[:-1]
            key, total, (check, place) = _merge_counts(np.concatenate([key, *[h[0] for h in held]]), np.concatenate([total, *[h[2] for h in held]]), [np.concatenate([check, *[h[1] for h in held]]), base[where] + at], most)
            pieces = pa.concat_arrays(every.take(pa.array(place)).chunks) if len(place) else pa.array([], pa.binary())
            held.clear()
            size = len(key)

        for b in chunked(batches, text):
            k, c, which, words, _, _ = _pretoken_hashes(b.column(text))
            held.append((k, c, np.bincount(which, minlength=len(k)).astype(np.int64), words))
            size += len(k)
            if size > 2 * COUNTED:
                settle(COUNTED)
        settle(frequent)
        if len(key):
            _, n = encode_pieces(*utf8(pieces), vocabulary(ranks))
            yield _summary_row(TaskContext.get().partitionId(), key, total, [check, n.astype(np.int32)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple] = {}
        for b in batches:
            for part, keys, checks, lengths, counts in zip(*[b.column(f.name).to_pylist() for f in _SUMMARY]):
                new = (np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), [np.frombuffer(checks, np.uint64), np.frombuffer(lengths, np.int32)])
                old = parts.get(part)
                if old is None:
                    parts[part] = new
                else:
                    parts[part] = _merge_counts(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]), [np.concatenate([a, c]) for a, c in zip(old[2], new[2])], frequent)
        for part, (key, total, rows) in parts.items():
            yield _summary_row(part, key, total, rows)

    narrow = df.select(F.col(text))
    summary = narrow.mapInArrow(count, _SUMMARY)
    nodes = narrow.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // 32)
        summary = summary.withColumn("part", (F.col("part") / 32).cast("int")).repartition(nodes, "part").mapInArrow(merge, _SUMMARY)
    got = summary.collect()  # one row at most, of 24 bytes for each frequent pre-token
    if not got:
        return {"key": np.zeros(0, np.uint64), "check": np.zeros(0, np.uint64), "length": np.zeros(0, np.int32)}
    return {"key": np.frombuffer(got[0].keys, np.uint64), "check": np.frombuffer(got[0].checks, np.uint64), "length": np.frombuffer(got[0].lengths, np.int32)}


_tables: dict[tuple, list[LengthTable]] = {}


def token_counts(df: DataFrame, text: str = "text", ranks: str = RANKS, frequent: int = FREQUENT, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text, without making the tokens.

    Lengths of frequent pre-tokens come from a broadcast table, those of others from a cache
    that a worker keeps between tasks; what neither holds is merged. Null and empty texts
    count 0.
    """
    known = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, ranks, frequent))

    def make(column: pa.Array) -> dict[str, pa.Array]:
        name = (known.value["key"].tobytes()[:64], ranks)
        if name not in _tables:
            _tables.clear()
            first = LengthTable()
            first.add(known.value["key"], known.value["check"], known.value["length"])
            _tables[name] = [first, LengthTable()]
        tables = _tables[name]
        key, check, which, words, off, cut = _pretoken_hashes(column)
        length = tables[0].get(key, check)
        miss = np.flatnonzero(length == 0)
        length[miss] = tables[1].get(key[miss], check[miss])
        miss = miss[length[miss] == 0]
        if len(miss):
            _, n = encode_pieces(*utf8(words.take(pa.array(miss))), vocabulary(ranks))
            length[miss] = n
            if tables[1].n + len(miss) > CACHED:
                tables[1] = LengthTable()
            tables[1].add(key[miss], check[miss], n.astype(np.int32))
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length[which], out=total[1:])
        return {out: pa.array(np.diff(total[np.searchsorted(cut, off)]), pa.int64())}

    return with_text_columns(df, text, T.StructType([T.StructField(out, T.LongType())]), make)
