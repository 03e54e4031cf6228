"""Query trees to Columns over the table of an index.

Predicates stay built-in expressions over plain columns wherever the type allows, so filters on
keywords, numbers and dates reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import Resolution, format_string, step_after, to_number, truncate
from ..operators.index import Index
from ..schema import NUMERIC, Field
from . import nodes as Q


def nothing() -> Column:
    return F.lit(False)


def glob_regex(pattern: str) -> str:
    """A wildcard pattern as an anchored regular expression; a backslash takes the next sign as it is."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quote(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or _quote(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _quote(c: str) -> str:
    return c if c.isalnum() or c == "_" else re.escape(c)


def _some(index: Index, field: Field, test) -> Column:
    """Whether a term of the field passes."""
    if field.is_number:
        return nothing()
    if field.type in ("text", "date") or field.multi:
        return F.exists(index.tokens(field.name), test)
    return test(F.col(f"`{field.source}`"))


def predicate(query: Q.Query | None, index: Index, known: Mapping[Q.Query, Column] | None = None) -> Column:
    """The condition of a query; null counts as false. A field that the index doesn't have matches nothing.

    known: conditions of some nodes that are there already, as columns. A node of a user's own gives
    its condition by a method to_column(index).
    """
    if known and query in known:
        return known[query]
    if query is None or isinstance(query, Q.MatchAll):
        return F.lit(True)
    if hasattr(query, "to_column"):
        return query.to_column(index)
    if isinstance(query, Q.Boost):
        return predicate(query.query, index, known)
    if isinstance(query, Q.Bool):
        return _bool(query, index, known)
    if isinstance(query, Q.MatchNone) or query.field not in index.fields:
        return nothing()
    field = index.fields[query.field]
    if isinstance(query, Q.Term):
        if field.type == "date" and query.text == "" and not field.multi:
            return F.col(f"`{field.source}`").isNull()
        if field.is_text or field.multi:
            return F.array_contains(index.tokens(field.name), query.text) if not field.is_number else nothing()
        return _some(index, field, lambda t: t == query.text)
    if isinstance(query, Q.AnyTerm):
        return _some(index, field, lambda t: t.isin(*query.texts)) if query.texts else nothing()
    if isinstance(query, Q.Phrase):
        return _phrase(index.tokens(field.name), query)
    if isinstance(query, Q.Prefix):
        return _some(index, field, lambda t: t.startswith(query.prefix))
    if isinstance(query, Q.Wildcard):
        return _some(index, field, lambda t: t.rlike(glob_regex(query.pattern)))
    if isinstance(query, Q.Regex):
        return _some(index, field, lambda t: t.rlike(f"^(?:{query.pattern})$"))
    if isinstance(query, Q.Fuzzy):
        return _some(index, field, lambda t: F.levenshtein(t, F.lit(query.text), query.edits).between(0, query.edits))
    if isinstance(query, Q.TermRange):
        return nothing() if query.is_empty() else _some(index, field, lambda t: _between(t, query.low, query.high, query.with_low, query.with_high))
    if isinstance(query, Q.Exists):
        return (F.size(index.values(field)) > 0) if field.multi else F.col(f"`{field.source}`").isNotNull()
    if isinstance(query, Q.Number):
        return _number(index, field, Q.NumberRange(query.field, query.type, query.value, query.value))
    if isinstance(query, Q.NumberRange):
        return _number(index, field, query)
    if isinstance(query, Q.DateRange):
        return _date(index, field, query)
    raise TypeError(f"no such query: {query!r}")


def _bool(query: Q.Bool, index: Index, known: Mapping[Q.Query, Column] | None) -> Column:
    must, should, never = ([predicate(q, index, known) for o, q in query.clauses if o == k] for k in (Q.MUST, Q.SHOULD, Q.MUST_NOT))
    if not must and not should:
        return nothing()
    # Beside a required clause the optional ones only count for the score
    base = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, should)
    # A plain comparison can be pushed into the scan; only its negation has to mind nulls
    return reduce(lambda a, b: a & ~F.coalesce(b, nothing()), never, base)


def _between(c: Column, low, high, with_low: bool, with_high: bool) -> Column:
    out = F.lit(True)
    if low is not None and high is not None and with_low and with_high:
        return c.between(low, high)
    if low is not None:
        out = (c >= low) if with_low else (c > low)
    if high is not None:
        top = (c <= high) if with_high else (c < high)
        out = top if low is None else out & top
    return out


def _phrase(tokens: Column, query: Q.Phrase) -> Column:
    terms = query.terms
    if not terms:
        return nothing()
    if len(terms) == 1:
        return F.array_contains(tokens, terms[0])
    every = reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in dict.fromkeys(terms)])
    # Places are only looked at where all terms are there
    return every & F.coalesce(F.when(every, phrase_count(token_places(tokens, terms), query) > 0), nothing())


def token_places(tokens: Column, terms: Sequence[str]) -> dict[str, Column]:
    """The places of some terms in an array of terms."""

    def of(term: str) -> Column:
        return F.filter(F.transform(tokens, lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())

    return {t: of(t) for t in dict.fromkeys(terms)}


def phrase_count(places: Mapping[str, Column], query: Q.Phrase) -> Column:
    """How many times a phrase occurs, from the places of its terms.

    Without slop the terms stand side by side. With slop, the places of the terms, each less its place
    in the phrase, all lie within slop of each other: one budget for the whole phrase. A term that the
    phrase has twice needs two places.
    """

    def less(place: Column, k: int) -> Column:
        return F.transform(place, lambda p: (p - k).cast("int"))

    def lows(at: Column) -> Column:
        """Where a window of slop + 1 may begin to hold one of the places."""
        return F.flatten(F.transform(at, lambda a: F.sequence(a - query.slop, a)))

    def within(place: Column, low: Column, a: int, b: int) -> Column:
        return F.size(F.filter(place, lambda p: p.between(low + a, low + b + query.slop)))

    shifted = [less(places[t], k) for k, t in enumerate(query.terms)]
    if not query.slop:
        return F.size(reduce(F.array_intersect, shifted))
    # Sets by hash: windows that hold every term, of those the ones that begin at a term
    fit = F.array_intersect(reduce(F.array_intersect, [lows(x) for x in shifted]), reduce(F.array_union, shifted))
    twice = [(places[t], spots) for t in places if len(spots := [k for k, x in enumerate(query.terms) if x == t]) > 1]
    if not twice:
        return F.size(fit)

    def apart(low: Column) -> Column:
        return reduce(lambda a, b: a & b, [within(place, low, spots[i], spots[j]) > j - i for place, spots in twice for i in range(len(spots)) for j in range(i, len(spots))])

    return F.size(F.filter(fit, apart))


def _number(index: Index, field: Field, q: Q.NumberRange) -> Column:
    if field.type != q.type or (q.low is None and q.high is None):
        return nothing()  # another type finds nothing, without an error
    kind = NUMERIC[q.type]
    low, high = (None if v is None else F.lit(v).cast(kind) for v in (q.low, q.high))

    def test(c: Column) -> Column:
        out = _between(c, low, high, q.with_low, q.with_high)
        return out & (c > 0) if q.compat and q.low is None and q.type in ("float", "double") else out

    return F.exists(index.values(field), test) if field.multi else test(F.col(f"`{field.source}`"))


def _literal(at: datetime, kind: str) -> Column:
    """A moment of the type of the column, so that the column needs no cast and can be pushed down."""
    if kind == "timestamp_ntz":
        return F.lit((at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at).isoformat(sep=" ")).cast(kind)
    return F.lit(at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)).cast("timestamp")


def date_bounds(q: Q.DateRange) -> tuple[datetime | None, datetime | None]:
    """[from, to) of a range in whole units of its resolution."""
    res = q.resolution
    wide = q.compat and q.numeric and res.digits > 8
    low = high = None
    if q.low is not None:
        low = truncate(q.low, res)
        if not q.with_low:
            low = low - (step_after(low, res) - low) if wide else step_after(low, res)
    if q.high is not None:
        high = truncate(q.high, res)
        if q.with_high:
            high = step_after(high, res)
        elif wide:
            high = step_after(step_after(high, res), res)
    return low, high


def _date(index: Index, field: Field, q: Q.DateRange) -> Column:
    if field.type != "date" or field.numeric != q.numeric or field.resolution != q.resolution:
        return nothing()
    if q.low is None and q.high is None:
        return nothing() if field.multi else F.col(f"`{field.source}`").isNull()
    low, high = date_bounds(q)
    kind = index.df.schema[field.source].dataType.simpleString().removeprefix("array<").removesuffix(">")

    def test(c: Column) -> Column:
        return _between(c, None if low is None else _literal(low, kind), None if high is None else _literal(high, kind), True, False)

    return F.exists(index.values(field), test) if field.multi else test(F.col(f"`{field.source}`"))


__all__ = ["Resolution", "date_bounds", "format_string", "glob_regex", "predicate", "to_number"]
