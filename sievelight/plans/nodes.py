"""Query trees. A node is plain data; plans.lower turns it into a Column."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from ..functions.dates import Resolution

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"


class Query:
    """Base of all nodes."""

    def is_empty(self) -> bool:
        return False

    def __and__(self, other: Query) -> Query:
        return all_of(self, other)

    def __or__(self, other: Query) -> Query:
        return any_of(self, other)


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Term(Query):
    """One exact term, not analysed; an empty text is a term like any other."""

    field: str
    text: str

    def is_empty(self) -> bool:
        return not self.field


@dataclass(frozen=True)
class AnyTerm(Query):
    field: str
    texts: tuple[str, ...]

    def is_empty(self) -> bool:
        return not self.texts


@dataclass(frozen=True)
class Phrase(Query):
    """Terms in successive places; with slop, in order within that many more places."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0

    @classmethod
    def of(cls, field: str, text: str) -> Phrase:
        """Cut at every single white space, so that two in a row make an empty term."""
        import re

        return cls(field, tuple(re.split(r"\s", text)))


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    pattern: str

    def __post_init__(self) -> None:
        if not any(c in self.pattern for c in "*?"):
            raise ValueError("a wildcard needs * or ?")


@dataclass(frozen=True)
class Regex(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    text: str
    edits: int = 2


@dataclass(frozen=True)
class TermRange(Query):
    """Terms in order of their bytes; an open end is None."""

    field: str
    low: str | None = None
    high: str | None = None
    with_low: bool = True
    with_high: bool = True

    def is_empty(self) -> bool:
        return self.low is None and self.high is None


@dataclass(frozen=True)
class Number(Query):
    """An exact number of one of the types int, long, float, double."""

    field: str
    value: float
    type: str


@dataclass(frozen=True)
class NumberRange(Query):
    """compat: an open lower end of a float or double leaves out zero and negatives."""

    field: str
    type: str
    low: float | None = None
    high: float | None = None
    with_low: bool = True
    with_high: bool = True
    compat: bool = False


@dataclass(frozen=True)
class DateRange(Query):
    """Dates at a resolution; low equal to high is one date; no bounds find fields with an empty date.

    compat: exclusive bounds of numeric dates below a day widen the range by one unit.
    """

    field: str
    low: datetime | None
    high: datetime | None
    resolution: Resolution = Resolution.DAY
    numeric: bool = False
    with_low: bool = True
    with_high: bool = True
    compat: bool = False

    @classmethod
    def exact(cls, field: str, at: datetime | None, resolution: Resolution = Resolution.DAY, numeric: bool = False) -> DateRange:
        return cls(field, at, at, resolution, numeric)


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float


@dataclass(frozen=True)
class Bool(Query):
    """Clauses (occur, query). Only negative clauses match nothing."""

    clauses: tuple[tuple[str, Query], ...]


def combine(occur: str, queries: list[Query]) -> Query:
    """One query as it is, more as a Bool."""
    return queries[0] if len(queries) == 1 else Bool(tuple((occur, q) for q in queries)) if queries else MatchNone()


def all_of(*queries: Query) -> Query:
    return combine(MUST, list(queries))


def any_of(*queries: Query) -> Query:
    return combine(SHOULD, list(queries))


def with_filters(base: Query | None, *filters: Query) -> Query:
    """base and every filter that isn't empty."""
    parts = [q for q in ([base] if base is not None else []) + list(filters) if not q.is_empty()]
    return all_of(*parts) if parts else MatchAll()


def boosted(query: Query, factor: float) -> Query:
    return query if factor == 1.0 else Boost(query, factor)


@dataclass(frozen=True)
class ValueFilter:
    """Values of a field, each with its occur; facets of the same field leave it out.

    type: None for strings, a numeric type, or 'date'.
    """

    name: str
    values: tuple[tuple[object, str], ...]
    type: str | None = None
    resolution: Resolution = Resolution.DAY

    def _one(self, value: object) -> Query:
        if self.type == "date":
            return DateRange.exact(self.name, value, self.resolution)
        return Number(self.name, value, self.type) if self.type else Term(self.name, value)

    def apply(self, base: Query | None) -> Query:
        own = tuple((occur, self._one(v)) for v, occur in self.values)
        if any(occur == SHOULD for occur, _ in own):
            return Bool(own) if base is None else all_of(base, Bool(own))
        return Bool(((MUST, base), *own) if base is not None else own)


def string_filter(name: str, **values: str) -> ValueFilter:
    return ValueFilter(name, tuple(values.items()))


def terms_of(query: Query) -> list[tuple[str, str, float]]:
    """(field, term, boost) of the terms that count for the score; negative clauses have none."""
    if isinstance(query, Term):
        return [(query.field, query.text, 1.0)]
    if isinstance(query, AnyTerm):
        return [(query.field, t, 1.0) for t in query.texts]
    if isinstance(query, Phrase):
        return [(query.field, t, 1.0) for t in query.terms]
    if isinstance(query, Boost):
        return [(f, t, b * query.factor) for f, t, b in terms_of(query.query)]
    if isinstance(query, Bool):
        return [x for occur, q in query.clauses if occur != MUST_NOT for x in terms_of(q)]
    return []


def substitute(query: Query, field: str, old: str, new: str) -> Query:
    """The query with one term of a field in place of another, wherever it stands; itself where it has none."""
    if isinstance(query, Term) and (query.field, query.text) == (field, old):
        return Term(field, new)
    if isinstance(query, Phrase) and query.field == field and old in query.terms:
        return Phrase(field, tuple(new if t == old else t for t in query.terms), query.slop)
    if isinstance(query, Boost):
        return Boost(substitute(query.query, field, old, new), query.factor)
    if isinstance(query, Bool):
        return Bool(tuple((occur, substitute(q, field, old, new)) for occur, q in query.clauses))
    return query
