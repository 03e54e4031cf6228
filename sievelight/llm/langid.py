"""Language identification by unigrams over a fixed vocabulary, all segmentations summed.

The pieces are those of a public vocabulary file. Each language has a probability for each
piece, fitted by expectation maximisation over all segmentations of the words of a bounded
sample of labelled documents, whole texts of any length. A word's likelihood is the sum over all
its segmentations, by the forward algorithm; a text's is the product over its words. Characters
that no piece covers have a small probability of their own, so every word has a segmentation.
Words may be of any length, as in scripts without spaces: where no piece spans two neighbouring
characters every segmentation has a cut, so the sum is taken run by run between such places, and
within a run it slides along with a scale of its own.

Words with digits say nothing about a language and don't count. A text is given the likeliest
language; ties go to the first in alphabetical order. It is rejected, with a null language, if it
has no words or if its words fit no language: the mean log-likelihood of a character is further
below that of the sample than `reject` times the spread of 16 characters, or of all of a shorter
text. Mixtures of languages aren't rejected.

Defined results: null and empty texts, and such without a word that counts, are rejected with
null scores. The whole of every text counts. Repeated rows get the same result. Without any
labelled text there are no languages, and all texts are rejected. An empty table stays empty.
All columns pass through; those named as an output column, in any case, are replaced.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LengthTable
from .text import ranges, ship, with_text_columns
from .words import Words, part_hash, part_hashes, words_of

#: A sentencepiece model, of which only the pieces are used.
PIECES = os.environ.get("SIEVELIGHT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Labelled documents per language for fitting, those of least hashed id, whatever their length.
SAMPLE = 300
ROUNDS = 3
REJECT = 8.0
_MARK = "▁"
_UNKNOWN = 1e-7  # of a character that no piece covers
_GROUP = 1 << 16  # characters of words looked at together; a longer word is a group of its own
_RESCALE = 8  # steps after which the sums of long runs are scaled anew


class Lattice:
    """The pieces of the vocabulary by hash, up to a length."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.pieces = sorted(p for p in pieces if p)
        self.longest = max(map(len, self.pieces))
        size = np.array([len(p) for p in self.pieces])
        cp = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32)
        acc, start = part_hashes(cp), np.cumsum(size) - size
        key = np.zeros(len(size), np.uint64)
        for n in np.unique(size):
            key[size == n] = part_hash(acc, start[size == n], int(n))
        self.none = len(self.pieces)  # the id of no piece
        #: By length: the hashes of the pieces in order, and their ids.
        self.sized = {int(n): (np.sort(key[size == n]), np.flatnonzero(size == n)[np.argsort(key[size == n])]) for n in np.unique(size)}

    def matches(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces within the words cp[off[i]:off[i+1]]."""
        acc = part_hashes(cp)
        room = np.repeat(off[1:], np.diff(off)) - np.arange(len(cp))
        out: list[list[np.ndarray]] = [[], [], []]
        for n, (keys, ids) in self.sized.items():
            at = np.flatnonzero(room >= n)
            key = part_hash(acc, at, n)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == key)
            for column, value in zip(out, (at[hit], np.full(len(hit), n), ids[place[hit]])):
                column.append(value)
        return tuple(np.concatenate(x) for x in out)


@lru_cache(2)
def lattice(path: str = PIECES) -> Lattice:
    return Lattice(path)


def _sweep(first: np.ndarray, size: np.ndarray, at: np.ndarray, to: np.ndarray, piece: np.ndarray, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of the beginnings of runs, as (value, log of its scale) for each place.

    Run i has the places first[i] .. first[i] + size[i], its end included. A piece goes from place
    `at` to place `to`; each place of a run follows from those before it.
    """
    langs = p.shape[1]
    value, scale = np.zeros((int(size.sum()) + len(size), langs)), np.zeros((int(size.sum()) + len(size), langs))
    value[first] = 1
    order = np.argsort(-size, kind="stable")  # the longest run first, so that those still going are the first ones
    first, size = first[order], size[order]
    run = np.searchsorted(np.sort(first), to, "right") - 1
    step = to - np.sort(first)[run]
    key = step * (longest + 1) + (to - at)
    by = np.argsort(key, kind="stable")
    at, to, piece, key = at[by], to[by], piece[by], key[by]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(key))
    steps = key[cuts] // (longest + 1)
    k = 0
    going = len(size)
    for e in range(1, int(size[0]) + 1 if len(size) else 0):
        while going and size[going - 1] < e:
            going -= 1
        here = first[:going] + e
        value[here] = value[here - 1] * _UNKNOWN
        scale[here] = scale[here - 1]
        while k < len(cuts) and steps[k] == e:
            i = slice(cuts[k], ends[k])
            value[to[i]] += value[at[i]] * p[piece[i]]
            k += 1
        if e % _RESCALE == 0 and size[0] > 2 * _RESCALE:
            # The places that later ones still look back at all come to the scale of this one
            grown = here[size[:going] > e]
            factor = 1 / value[grown]
            scale[grown] -= np.log(factor)
            for back in range(min(e, longest) + 1):
                value[grown - back] *= factor
                scale[grown - back] = scale[grown]
    return value, scale


def word_scores(w: Words, p: np.ndarray, lat: Lattice, expect: np.ndarray | None = None) -> np.ndarray:
    """log-likelihood of each distinct word in each language; p[piece, language], 0 for no piece.

    expect: occurrences of each word in each language; then (scores, expected counts of pieces).
    """
    words, langs = len(w.off) - 1, p.shape[1]
    out = np.zeros((words, langs))
    counts = np.zeros_like(p)
    lo = 0
    while lo < words:
        hi = max(lo + 1, int(np.searchsorted(w.off, w.off[lo] + _GROUP, "right")) - 1)
        off = w.off[lo : hi + 1] - w.off[lo]
        at, size, piece = lat.matches(w.cp[w.off[lo] : w.off[hi]], off)
        # Places inside a word that a piece spans; every segmentation has a cut at the others
        spanned = np.zeros(off[-1] + 1, np.int64)
        long = size > 1
        np.add.at(spanned, at[long] + 1, 1)
        np.add.at(spanned, at[long] + size[long], -1)
        begin = np.cumsum(spanned)[:-1] == 0
        begin[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, off[-1]))
        of_word = np.searchsorted(off, start, "right") - 1
        # Each run has a place more than characters
        first = start + np.arange(len(start))
        shift = np.searchsorted(start, at, "right") - 1
        a, b = at + shift, at + size + shift
        value, scale = _sweep(first, length, a, b, piece, p, lat.longest)
        last = first + length
        total = np.log(value[last]) + scale[last]
        for k in range(langs):
            out[lo:hi, k] = np.bincount(of_word, total[:, k], hi - lo)
        if expect is not None and len(start):
            # The same from the other end, places counted backwards
            flip = int(last[-1])
            back, back_scale = _sweep((flip - last)[::-1], length[::-1], flip - b, flip - a, piece, p, lat.longest)
            run = shift
            weight = expect[lo + of_word[run]] * np.exp(scale[a] + back_scale[flip - b] - total[run])
            use = value[a] * p[piece] * back[flip - b] * weight
            for k in range(langs):
                counts[:, k] += np.bincount(piece, use[:, k], len(p))
        lo = hi
    return out if expect is None else (out, counts)


def sizes(w: Words) -> np.ndarray:
    """Characters of each distinct word; 0, so that it doesn't count, for one with a digit."""
    size = np.diff(w.off) - 1
    digit = np.add.reduceat(((w.cp >= 48) & (w.cp <= 57)).astype(np.int64), w.off[:-1]) if len(size) else size
    return np.where(digit > 0, 0, size)


#: Words whose scores a worker keeps.
CACHED = 1 << 18
_cache: dict[tuple, tuple[LengthTable, list[np.ndarray]]] = {}


def cached_scores(w: Words, model: dict, lat: Lattice) -> np.ndarray:
    """word_scores, from what this worker already knows where it can be."""
    name = (id(lat), tuple(model["langs"]), model["p"][:64].tobytes())
    if name not in _cache or _cache[name][0].n > CACHED:
        _cache.clear()
        _cache[name] = LengthTable(), [np.zeros((0, model["p"].shape[1]))]
    table, held = _cache[name]
    at = table.get(w.key, w.check)
    out = held[0][at - 1] if len(held[0]) else np.zeros((len(at), model["p"].shape[1]))
    miss = np.flatnonzero(at == 0)
    if len(miss):
        size = np.diff(w.off)[miss]
        off = np.zeros(len(miss) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        part = Words(w.cp[np.repeat(w.off[miss], size) + ranges(size)], off, w.which, w.doc, w.key[miss], w.check[miss])
        out[miss] = word_scores(part, model["p"], lat)
        table.add(w.key[miss], w.check[miss], np.arange(len(miss), dtype=np.int32) + len(held[0]) + 1)
        held[0] = np.concatenate([held[0], out[miss]])
    return out


def fit(texts: list[str], labels: list[str], path: str = PIECES, rounds: int = ROUNDS) -> dict:
    """Model from labelled texts: languages, p[piece, language], mean and spread of scores."""
    langs = sorted(set(labels))
    lat = lattice(path)
    if not langs:
        return {"langs": [], "p": np.zeros((lat.none + 1, 0)), "mean": np.zeros(0), "sd": np.zeros(0)}
    w = words_of(pa.array(texts, pa.string()), _MARK)
    label = np.searchsorted(langs, labels)[w.doc]
    n = np.stack([np.bincount(w.which[label == k], minlength=len(w.key)) for k in range(len(langs))], axis=1).astype(float)
    p = np.full((lat.none + 1, len(langs)), 1 / lat.none)
    p[lat.none] = 0
    for _ in range(rounds):
        _, counts = word_scores(w, p, lat, n)
        counts[: lat.none] += 0.01
        p = counts / counts.sum(0)
        p[lat.none] = 0
    size = sizes(w)
    score = word_scores(w, p, lat) * (size > 0)[:, None]
    chars = size[w.which].astype(float)
    total = np.bincount(w.doc, chars, len(texts))
    mean, sd = np.zeros(len(langs)), np.zeros(len(langs))
    for k in range(len(langs)):
        mine = (np.array(labels) == langs[k]) & (total > 0)
        s = np.bincount(w.doc, score[w.which, k], len(texts))
        # The spread of a single character's score, as if characters were independent.
        mean[k] = s[mine].sum() / total[mine].sum()
        sd[k] = 1.4826 * np.median(np.abs(s[mine] - mean[k] * total[mine]) / np.sqrt(total[mine]))
    return {"langs": langs, "p": p, "mean": mean, "sd": sd}


def score_column(column: pa.Array, model: dict, path: str = PIECES, reject: float = REJECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language or -1, mean log-likelihood of a character, its lead over the next language)."""
    n, langs = len(column), len(model["langs"])
    w = words_of(column, _MARK)
    if not langs:
        return np.full(n, -1), np.full(n, np.nan), np.full(n, np.nan)
    size = sizes(w)
    score = cached_scores(w, model, lattice(path)) * (size > 0)[:, None]
    chars = np.bincount(w.doc, size[w.which], n)
    total = np.stack([np.bincount(w.doc, score[w.which, k], n) for k in range(langs)], axis=1).astype(float)
    best = total.argmax(1)
    top = total[np.arange(n), best]
    rest = total.copy()
    rest[np.arange(n), best] = -np.inf
    size = np.maximum(chars, 1)
    least = model["mean"][best] - reject * model["sd"][best] * np.maximum(1 / np.sqrt(size), 0.25)
    lead = np.where(chars > 0, (top - rest.max(1)) / size if langs > 1 else np.inf, np.nan)
    mean = np.where(chars > 0, top / size, np.nan)
    return np.where((chars > 0) & (mean >= least - 1e-9), best, -1), mean, lead


def sample(df: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """A bounded sample: per label the `size` documents of least hashed id that have a text."""
    rows = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("l")).where("i is not null and l is not null and length(t) > 0")
    ids = rows.select("i", "l").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))).where(F.col("nth") <= size).select("i", "l")
    got = rows.join(F.broadcast(ids), ["i", "l"]).dropDuplicates(["i", "l"]).select("t", "l").collect()  # `size` rows a label
    return [r.t for r in got], [r.l for r in got]


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", path: str = PIECES, size: int = SAMPLE) -> dict:
    order = sorted(zip(*sample(df, id_col, text, label, size)), key=lambda x: (x[1], x[0]))
    return fit([t for t, _ in order], [x for _, x in order], path)


def identify(df: DataFrame, model: dict, text: str = "text", out: str = "language", score: str = "score", lead: str = "lead", path: str = PIECES, reject: float = REJECT) -> DataFrame:
    """df with the language (null: rejected), the mean log-likelihood of a character and its lead."""
    sent = ship(df).sparkSession.sparkContext.broadcast(model)  # the vocabulary times the languages
    schema = T.StructType([T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(lead, T.DoubleType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        best, mean, ahead = score_column(column, sent.value, path, reject)
        names = pa.array([*sent.value["langs"], None], pa.string())
        return {out: names.take(pa.array(np.where(best < 0, len(names) - 1, best))), score: pa.array(mean, from_pandas=True), lead: pa.array(ahead, from_pandas=True)}

    return with_text_columns(df, text, schema, make)
