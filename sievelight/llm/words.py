"""The words of a chunk of texts as distinct arrays of code points, and hashes of their parts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text import lower, mix64, powers, ranges, span_hashes, utf8, word_spans

@dataclass
class Words:
    """Distinct words of a chunk, and where they stand.

    cp, off: code points of the distinct words, with `edge` before and after each;
    which, doc: per occurrence the distinct word and the text;
    key, check: two 64-bit hashes of each distinct word.
    """

    cp: np.ndarray
    off: np.ndarray
    which: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    check: np.ndarray


def words_of(column: pa.Array, before: str, after: str = "") -> Words:
    """Lower-case words of any length: runs of ASCII letters and digits and of anything beyond ASCII."""
    raw, off = utf8(lower(column))
    start, end = word_spans(raw, off, True)
    doc = np.searchsorted(off, start, "right") - 1
    key = span_hashes(raw, start, end)
    distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
    n = end[first] - start[first]
    flat = raw[np.repeat(start[first], n) + ranges(n)]
    lead = (flat & 0xC0) != 0x80
    chars = np.add.reduceat(lead.astype(np.int64), np.cumsum(n) - n) if len(n) else n
    cp = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    edges = len(before) + len(after)
    out_off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(chars + edges, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint32)
    out[np.repeat(out_off[:-1] + len(before), chars) + ranges(chars)] = cp
    for i, c in enumerate(before):
        out[out_off[:-1] + i] = ord(c)
    for i, c in enumerate(after):
        out[out_off[1:] - len(after) + i] = ord(c)
    return Words(out, out_off, which, doc, distinct, span_hashes(flat, np.cumsum(n) - n, np.cumsum(n), 12))


def part_hashes(cp: np.ndarray) -> np.ndarray:
    """Sums from which part_hash takes the hash of any part."""
    up, _ = powers(len(cp) + 1)
    acc = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix64(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=acc[1:])
    return acc


def part_hash(acc: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of cp[start:start+size]; equal parts anywhere have equal hashes."""
    _, down = powers(len(acc))
    return mix64((acc[start + size] - acc[start]) * down[start] + np.uint64(size))
