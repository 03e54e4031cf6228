"""Extracts around a term, and highlighted fragments."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import UNICODE, Analyzer

DOTS = "..."


def _escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def extract(text: Column, term: str, length: int = 200, dots: str = DOTS) -> Column:
    """About `length` characters around the first whole-word occurrence of term, in any case; null without one.

    The extract is a window of the text with the term in its middle, moved so as not to begin before
    the text or end after it; a side that is cut has dots.
    """
    if len(term) > length:
        raise ValueError("the term is longer than the extract")
    spare, half = length - len(term), (length - len(term)) // 2
    size = F.length(text)
    at = F.regexp_instr(text, F.lit(rf"(?i)(?<![0-9A-Za-z_]){re.escape(term)}(?![0-9A-Za-z_])")) - 1
    end = at + len(term)
    rest = size - end
    cut = size >= length
    first = at < half
    last = ~first & (rest < half)
    cut_left = cut & ~first & ~(last & (rest > at))
    cut_right = cut & ~last & ~(first & (rest < spare - at))
    low = F.when(~cut_left, F.lit(0)).when(last, at - rest).otherwise(at - half)
    high = F.when(~cut_right, size).when(first, length - 1).otherwise(end + half)
    part = lambda a, b: _escape(text.substr(a + 1, F.greatest(b - a, F.lit(0))))
    mark = lambda flag: F.when(flag, F.lit(dots)).otherwise("")
    return F.when(at >= 0, F.concat(mark(cut_left), part(low, at), F.lit("<term>"), part(at, end), F.lit("</term>"), part(end, high), mark(cut_right)))


def first_extract(columns: Iterable[Column], term: str, length: int = 200) -> Column:
    """The extract of the first column that has the term."""
    return F.coalesce(*[extract(c, term, length) for c in columns])


def fragments(text: str, weights: dict[str, float], length: int, most: int = 1, marker: str = "term", escape: bool = True, analyzer: Analyzer = UNICODE) -> list[str]:
    """The best fragments of about `length` characters, terms marked, by the weight of their distinct terms."""
    import regex

    spans = [m.span() for m in regex.finditer(analyzer.pattern, text)] if analyzer.pattern else [(0, len(text))]
    pieces: list[list[tuple[int, int]]] = []
    limit = 0
    for s, e in spans:
        if not pieces or e >= limit:
            pieces.append([])
            limit = e + length if len(pieces) > 1 else length
            limit = max(limit, e + 1) if len(pieces) == 1 else limit
        pieces[-1].append((s, e))
    fold = str.lower if analyzer.lowercase else str
    scored = []
    for k, piece in enumerate(pieces):
        words = {fold(text[s:e]) for s, e in piece} & weights.keys()
        if words:
            scored.append((-sum(weights[w] for w in words), k))
    quote = (lambda t: html.escape(t).replace("&#x27;", "'")) if escape else str
    out = []
    for _, k in sorted(scored)[:most]:
        begin = 0 if k == 0 else pieces[k][0][0]
        stop = pieces[k + 1][0][0] if k + 1 < len(pieces) else len(text)
        done, at = [], begin
        for s, e in pieces[k]:
            if fold(text[s:e]) in weights:
                done += [quote(text[at:s]), f"<{marker}>", quote(text[s:e]), f"</{marker}>"]
                at = e
        out.append("".join([*done, quote(text[at:stop])]).strip())
    return out


def highlight(text: Column, weights: dict[str, float], length: int, marker: str = "term", escape: bool = True, analyzer: Analyzer = UNICODE) -> Column:
    """The best fragment of each text, null where no term occurs. Only texts with a term reach Python."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: next(iter(fragments(t, weights, length, 1, marker, escape, analyzer)), None) if t is not None else None)

    return F.when(F.arrays_overlap(analyzer.tokens(text), F.array(*[F.lit(w) for w in weights])), run(text))
