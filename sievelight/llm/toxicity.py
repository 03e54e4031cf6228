"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word has a vector for itself and one for each of its character n-grams, of 3 to 5 characters
with marks at its ends, in hashed rows of one table; unseen spellings share the n-grams of
seen ones. A passage is the mean over its words of the means of their vectors, and a linear
softmax over two classes judges it. Vectors and softmax are trained jointly, in numpy, on a
bounded sample of labelled documents, whole texts of any length. A row counts the less the fewer
documents of the sample have it: by df / (df + PRIOR), in training and in scoring alike, so that a
spelling of few documents isn't learnt by heart. As labels are of documents, while a few words
make one toxic, training takes three turns: first every passage has its document's label, then in
toxic documents only the passages that stood out, at least the highest, are positive. Every turn
takes the same number of steps, whatever the size of the sample.

A document's score is the highest probability over all its passages of PASSAGE words, those
that start at any word, so the length of a text doesn't dilute it. The threshold lies between
the scores of the sample's clean and toxic documents.

Defined results: null and empty texts and texts without words score 0. A text shorter than a
passage is one passage. A word that is repeated at once counts once. The whole of every text
counts, and words of any length. Labels that are null, and documents without one, aren't trained
on; with a single class or none in the sample, every score is 0 and nothing is toxic. Repeated
rows score alike. All columns pass through; those named as an output column, in any case, are
replaced. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LengthTable
from .text import mix64, ranges, ship, with_text_columns
from .words import Words, part_hash, part_hashes, words_of

#: Labelled documents for training, clean and toxic, those of least hashed id.
SAMPLE = (4000, 1600)
ROWS, WIDTH, PASSAGE = 1 << 20, 8, 5
GRAMS = (3, 4, 5)
#: Documents of the sample at which a row counts half.
PRIOR = 3.0
#: One document in so many of the sample sets the threshold.
HELD = 4
TURNS, STEPS, BATCH, RATE, DECAY = 3, 500, 2048, 0.1, 1e-4
#: How often an error in a clean document counts for the threshold: such documents are the most.
CLEAN = 10
CACHED = 1 << 19


def subwords(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, how many per distinct word): the word itself, then its n-grams."""
    size = np.diff(w.off)
    acc = part_hashes(w.cp)
    rows, words = [mix64(w.key + np.uint64(3))], [np.arange(len(size))]
    for n in GRAMS:
        many = np.maximum(size - n + 1, 0)
        start = np.repeat(w.off[:-1], many) + ranges(many)
        rows.append(part_hash(acc, start, n))
        words.append(np.repeat(np.arange(len(size)), many))
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return (np.concatenate(rows)[order] & np.uint64(ROWS - 1)).astype(np.int64), np.bincount(word, minlength=len(size))


def bag_words(column: pa.Array) -> Words:
    """Words with marks at their ends; of a word that is repeated at once, only the first."""
    w = words_of(column, "<", ">")
    again = np.append(False, (w.which[1:] == w.which[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(w.which)]
    w.which, w.doc = w.which[~again], w.doc[~again]
    return w


def _passages(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each passage of PASSAGE words, without overlap, and its document."""
    count = np.bincount(w.doc, minlength=n)
    parts = -(-count // PASSAGE)
    begin = np.cumsum(count) - count
    return np.repeat(begin, parts) + PASSAGE * ranges(parts), np.repeat(np.arange(n), parts)


def _among(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, in order; the place of each value among them) of numbers below size, without a sort."""
    there = np.zeros(size, bool)
    there[values] = True
    some = np.flatnonzero(there)
    place = np.empty(size, np.int64)
    place[some] = np.arange(len(some))
    return some, place[values]


def gradients(table: np.ndarray, out: np.ndarray, rows: np.ndarray, many: np.ndarray, shrink: np.ndarray, word: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows, gradient of each, gradient of out) of the weighted cross entropy of passages.

    word: the words of one passage after the other, `size` of them each; rows and many are those
    of all distinct words; a row's vector counts by `shrink`.
    """
    distinct, which = _among(word, len(many))
    first = (np.cumsum(many) - many)[distinct]
    n = many[distinct]
    row = rows[np.repeat(first, n) + ranges(n)]
    of_word = np.repeat(np.arange(len(distinct)), n)
    part = (shrink[row] / n[of_word]).astype(np.float32)
    vector = np.add.reduceat(table[row] * part[:, None], np.cumsum(n) - n, axis=0)
    share = np.repeat(1 / size, size).astype(np.float32)
    mean = np.add.reduceat(vector[which] * share[:, None], np.cumsum(size) - size, axis=0)
    logit = mean @ out
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(size)), label] -= 1
    p *= weight[:, None]
    down = np.repeat(p @ out.T, size, axis=0) * share[:, None]
    of_row, place = _among(row, len(table))
    grad = np.empty((len(of_row), table.shape[1]), np.float32)
    for k in range(table.shape[1]):
        by_word = np.bincount(which, down[:, k], len(distinct))
        grad[:, k] = np.bincount(place, by_word[of_word] * part, len(of_row))
    return of_row, grad, mean.T @ p


def _train(w: Words, rows: np.ndarray, many: np.ndarray, shrink: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray, table: np.ndarray, out: np.ndarray, seed: int) -> None:
    """Adaptive gradient descent over passages, changing table and out; only rows that occur in a step are touched."""
    sums, out_sum = np.full_like(table, 1e-12), np.full_like(out, 1e-12)
    rng = np.random.Generator(np.random.PCG64(seed))
    weight = len(label) / (2 * np.maximum(np.bincount(label, minlength=2), 1))
    order, lo = rng.permutation(len(label)), 0
    for step in range(STEPS):
        if lo >= len(order):
            order, lo = rng.permutation(len(label)), 0
        at = order[lo : lo + BATCH]
        lo += BATCH
        word = w.which[np.repeat(start[at], size[at]) + ranges(size[at])]
        row, grad, down = gradients(table, out, rows, many, shrink, word, size[at], label[at], weight[label[at]] / len(at))
        rate = RATE * (1 - step / STEPS)
        out_sum += down**2
        out -= rate * down / np.sqrt(out_sum)
        grad += DECAY * table[row]
        sums[row] += grad * grad
        table[row] -= rate * grad / np.sqrt(sums[row])


def _word_scores(rows: np.ndarray, many: np.ndarray, lean: np.ndarray) -> np.ndarray:
    """Per distinct word the difference of the two logits that it would have alone."""
    return np.add.reduceat(lean[rows], np.cumsum(many) - many) / many if len(many) else np.zeros(0)


def document_scores(which: np.ndarray, doc: np.ndarray, n: int, word: np.ndarray) -> np.ndarray:
    """Per document the highest mean of PASSAGE successive words; NaN without words."""
    out = np.full(n, np.nan)
    if not len(which):
        return out
    acc = np.append(0, np.cumsum(word[which]))
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    some = np.flatnonzero(count)
    size = np.minimum(count, PASSAGE)
    tests = (count - size + 1)[some]
    start = np.repeat(begin[some], tests) + ranges(tests)
    width = np.repeat(size[some], tests)
    out[some] = np.maximum.reduceat((acc[start + width] - acc[start]) / width, np.cumsum(tests) - tests)
    return out


def _doc_counts(w: Words, rows: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """In how many of n texts each row stands."""
    first = np.cumsum(many) - many
    out = np.zeros(ROWS, np.int32)
    edge = np.searchsorted(w.doc, np.arange(n + 1))
    for lo, hi in zip(edge[:-1], edge[1:]):
        word, _ = _among(w.which[lo:hi], len(many)) if hi - lo > 1 << 12 else (np.unique(w.which[lo:hi]), None)
        # A row that comes twice here still counts once
        out[rows[np.repeat(first[word], many[word]) + ranges(many[word])]] += 1
    return out


def fit(texts: list[str], labels: list[int]) -> dict:
    """Model of labelled texts: lean[row], the difference of the logits of a row's vector, and a threshold on the logit."""
    label = np.array(labels, np.int64)
    if len(np.unique(label)) < 2:
        return {"lean": None, "threshold": np.inf}
    w = bag_words(pa.array(texts, pa.string()))
    rows, many = subwords(w)
    start, doc = _passages(w, len(texts))
    held = np.arange(len(texts)) % HELD == HELD - 1  # not trained on, for the threshold
    if len(np.unique(label[held])) < 2 or len(np.unique(label[~held])) < 2:
        held[:] = False
    start, doc = start[~held[doc]], doc[~held[doc]]
    count = np.bincount(w.doc, minlength=len(texts))
    size = np.minimum(PASSAGE, (np.cumsum(count))[doc] - start)
    seen = _doc_counts(w, rows, many, len(texts))
    common = np.flatnonzero(seen)
    compact = np.zeros(ROWS, np.int64)
    compact[common] = np.arange(len(common))
    rows = compact[rows]
    shrink = (seen[common] / (seen[common] + PRIOR)).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(17))

    y = label[doc]
    keep, positive = np.ones(len(y), bool), y == 1
    for turn in range(TURNS):
        table, out = ((rng.random((len(common), WIDTH)) - 0.5) / WIDTH).astype(np.float32), (rng.random((WIDTH, 2)) - 0.5).astype(np.float32)
        _train(w, rows, many, shrink, start[keep], size[keep], positive[keep].astype(np.int64), table, out, turn)
        lean = (table @ (out[:, 1] - out[:, 0]) * shrink).astype(np.float32)
        word = _word_scores(rows, many, lean)
        acc = np.append(0, np.cumsum(word[w.which]))
        score = (acc[start + size] - acc[start]) / size
        # Passages of toxic documents that hardly any clean passage reaches, and the highest of each.
        stand = score > np.quantile(score[y == 0], 0.9995)
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, doc, score)
        positive = (y == 1) & (stand | (score == high[doc]))
        keep = positive | (y == 0)
    final = document_scores(w.which, w.doc, len(texts), word)
    known = ~np.isnan(final) & (held if held.any() else True)
    spread = np.zeros(ROWS, np.float32)
    spread[common] = lean
    return {"lean": spread, "threshold": cutoff(final[known], label[known])}


def cutoff(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold of least errors, one in a clean document counting CLEAN times; of equals in the widest gap, nearer its upper end."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    errors = np.append(0, np.cumsum(y)) + CLEAN * np.append(np.cumsum((y == 0)[::-1])[::-1], 0)
    best = np.flatnonzero(errors == errors.min())
    best = best[(best > 0) & (best < len(s))]
    if not len(best):
        return float(s[-1] + 1)
    gap = s[best] - s[best - 1]
    at = best[gap.argmax()]
    return float(s[at] - gap.max() / 4)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, size: tuple[int, int]) -> tuple[list[str], list[int]]:
    """Per class the size[class] labelled documents of least hashed id that have a text; a document with both labels is toxic."""
    marked = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    held = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t")).where("length(t) > 0")
    ids = held.select("i").distinct().join(marked, "i").withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))).where(F.col("nth") <= F.when(F.col("y") == 0, size[0]).otherwise(size[1])).select("i", "y")
    got = held.join(F.broadcast(ids), "i").dropDuplicates(["i"]).select("i", "t", "y").collect()  # size[class] rows
    got.sort(key=lambda r: r.i)
    return [r.t for r in got], [r.y for r in got]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", size: tuple[int, int] = SAMPLE) -> dict:
    return fit(*sample(docs, labels, id_col, text, label, size))


_cache: dict[tuple, tuple[LengthTable, list[np.ndarray]]] = {}


def score_column(column: pa.Array, model: dict) -> np.ndarray:
    """Logits by document, NaN without words, from a worker's cache of words where it has them."""
    w = bag_words(column)
    if model["lean"] is None:
        return np.full(len(column), np.nan)
    name = (model["threshold"], model["lean"][:64].tobytes())
    if name not in _cache or _cache[name][0].n > CACHED:
        _cache.clear()
        _cache[name] = LengthTable(), [np.zeros(0)]
    table, held = _cache[name]
    at = table.get(w.key, w.check)
    word = held[0][at - 1] if len(held[0]) else np.zeros(len(at))
    miss = np.flatnonzero(at == 0)
    if len(miss):
        size = np.diff(w.off)[miss]
        off = np.append(0, np.cumsum(size))
        part = Words(w.cp[np.repeat(w.off[miss], size) + ranges(size)], off, w.which, w.doc, w.key[miss], w.check[miss])
        word[miss] = _word_scores(*subwords(part), model["lean"])
        table.add(w.key[miss], w.check[miss], np.arange(len(miss), dtype=np.int32) + len(held[0]) + 1)
        held[0] = np.concatenate([held[0], word[miss]])
    return document_scores(w.which, w.doc, len(column), word)


def classify(df: DataFrame, model: dict, text: str = "text", score: str = "score", toxic: str = "is_toxic") -> DataFrame:
    """df with the highest probability over its passages and whether it reaches the threshold."""
    sent = ship(df).sparkSession.sparkContext.broadcast(model)  # 1 MB for any corpus
    schema = T.StructType([T.StructField(score, T.DoubleType()), T.StructField(toxic, T.BooleanType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        logit = score_column(column, sent.value)
        known = ~np.isnan(logit)
        p = np.where(known, 1 / (1 + np.exp(-np.where(known, logit, 0))), 0)
        return {score: pa.array(p), toxic: pa.array(known & (np.where(known, logit, 0) >= sent.value["threshold"]))}

    return with_text_columns(df, text, schema, make)
