"""Search: filter, score, sort, page and count.

Where an index has stored postings, the nodes of a query that ask for terms of texts are answered
from them: one pruned read, one aggregation by document, one join. Otherwise they are conditions on
the texts themselves. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_date_string, string_to_iso
from ..plans import nodes as Q
from ..plans.lower import glob_regex, phrase_count, predicate, token_places
from ..plans.nodes import Query
from .index import Index

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Page:
    """Page `number` of `size` hits, from 1."""

    number: int = 1
    size: int = 20

    def __post_init__(self) -> None:
        if self.number < 1:
            raise ValueError("pages begin at 1")

    @property
    def first(self) -> int:
        return self.size * (self.number - 1) + 1

    def count(self, total: int) -> int:
        return 1 if self.size <= 0 or total == 0 else (total - 1) // self.size + 1


_TERMS = (Q.Term, Q.AnyTerm, Q.Phrase)
_PATTERNS = (Q.Prefix, Q.Wildcard, Q.Regex, Q.Fuzzy, Q.TermRange)


def leaves(query: Query | None) -> Iterator[Query]:
    """The nodes without parts."""
    if isinstance(query, Q.Boost):
        yield from leaves(query.query)
    elif isinstance(query, Q.Bool):
        for _, q in query.clauses:
            yield from leaves(q)
    elif query is not None:
        yield query


def _pairs(leaf: Query) -> list[tuple[str, str]]:
    texts = [leaf.text] if isinstance(leaf, Q.Term) else list(leaf.texts if isinstance(leaf, Q.AnyTerm) else leaf.terms)
    return [(leaf.field, t) for t in dict.fromkeys(texts)]


def _term_test(leaf: Query) -> Column:
    """Whether a term of the dictionary answers a pattern."""
    t = F.col("term")
    if isinstance(leaf, Q.Prefix):
        return t.startswith(leaf.prefix)
    if isinstance(leaf, Q.Wildcard):
        return t.rlike(glob_regex(leaf.pattern))
    if isinstance(leaf, Q.Regex):
        return t.rlike(f"^(?:{leaf.pattern})$")
    if isinstance(leaf, Q.Fuzzy):
        return F.levenshtein(t, F.lit(leaf.text), leaf.edits).between(0, leaf.edits)
    low = F.lit(True) if leaf.low is None else (t >= leaf.low) if leaf.with_low else (t > leaf.low)
    high = F.lit(True) if leaf.high is None else (t <= leaf.high) if leaf.with_high else (t < leaf.high)
    return low & high if leaf.low is not None or leaf.high is not None else F.lit(False)


def _stored(index: Index, query: Query | None) -> list[Query]:
    """The nodes of a query that stored postings answer."""
    return [q for q in dict.fromkeys(leaves(query)) if isinstance(q, _TERMS + _PATTERNS) and index.reads_postings([q.field]) and index.fields[q.field].is_text and not (isinstance(q, _TERMS) and not _pairs(q))]


@dataclass(frozen=True)
class Hits:
    """Documents with a column for each term, phrase and pattern of a query; columns of df named __ are of no one else."""

    df: DataFrame
    known: dict[Query, Column]
    tf: dict[tuple[str, str], Column]
    phrases: dict[Query, Column]
    lengths: dict[str, Column]


def hits(index: Index, query: Query | None, scored: bool = False) -> Hits:
    """The matches of a query, joined to what postings say about them.

    A query that can't be true without one of its terms takes only the documents of the postings.
    """
    own = _stored(index, query)
    if not own:
        return Hits(index.df.where(predicate(query, index)), {}, {}, {}, {})
    terms = [p for q in own if isinstance(q, _TERMS) for p in _pairs(q)]
    patterns = [q for q in own if isinstance(q, _PATTERNS)]
    found = index.inverted.of_terms(list(dict.fromkeys(terms))) if terms else None
    columns = ["doc", "field", "term", "tf", "positions", "length"]
    parts = [found.select(*columns)] if terms else []
    for q in patterns:
        # The terms come from the dictionary: what they are isn't known before it is read
        words = index.inverted.terms(q.field).where(_term_test(q)).select("term", F.lit(q.field).alias("field"))
        parts.append(index.inverted.of(q.field).join(words, ["field", "term"]).select(*columns))
    rows = reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(["doc", "field", "term"]) if len(parts) > 1 else parts[0]
    unique = list(dict.fromkeys(terms))
    is_term = lambda p: (F.col("field") == p[0]) & (F.col("term") == p[1])
    placed = {p for q in own if isinstance(q, Q.Phrase) and len(q.terms) > 1 for p in _pairs(q)}
    aggregates = [F.coalesce(F.max(F.when(is_term(p), F.col("tf"))), F.lit(0)).alias(f"__tf{i}") for i, p in enumerate(unique)]
    aggregates += [F.max(F.when(is_term(p), F.col("positions"))).alias(f"__at{i}") for i, p in enumerate(unique) if p in placed]
    aggregates += [F.max((F.col("field") == q.field) & _term_test(q)).alias(f"__p{i}") for i, q in enumerate(patterns)]
    fields = list(dict.fromkeys(q.field for q in own))
    if scored:
        aggregates += [F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"__len{i}") for i, f in enumerate(fields)]
    by_doc = rows.groupBy("doc").agg(*aggregates).withColumnRenamed("doc", "__doc")
    tf = {p: F.coalesce(F.col(f"__tf{i}"), F.lit(0)) for i, p in enumerate(unique)}
    none = F.array().cast("array<int>")
    known: dict[Query, Column] = {}
    phrases: dict[Query, Column] = {}
    for q in own:
        if isinstance(q, Q.Phrase) and len(q.terms) > 1:
            at = {t: F.coalesce(F.col(f"__at{unique.index((q.field, t))}"), none) for t in dict.fromkeys(q.terms)}
            phrases[q] = phrase_count(at, q)
            known[q] = phrases[q] > 0
        elif isinstance(q, _TERMS):
            known[q] = reduce(lambda a, b: a | b, [tf[p] > 0 for p in _pairs(q)]) if _pairs(q) else F.lit(False)
        else:
            known[q] = F.coalesce(F.col(f"__p{patterns.index(q)}"), F.lit(False))
    joined = index.df.join(by_doc, F.col(f"`{index.order}`") == F.col("__doc"), "inner" if _needs(query, set(own)) else "left")
    return Hits(joined.where(predicate(query, index, known)), known, tf, phrases, {f: F.col(f"__len{i}") for i, f in enumerate(fields)} if scored else {})


def _needs(query: Query | None, own: set[Query]) -> bool:
    """Whether a query is false for documents without any of the terms."""
    if isinstance(query, Q.Boost):
        return _needs(query.query, own)
    if isinstance(query, Q.Bool):
        must = [q for o, q in query.clauses if o == Q.MUST]
        should = [q for o, q in query.clauses if o == Q.SHOULD]
        return any(_needs(q, own) for q in must) or (not must and bool(should) and all(_needs(q, own) for q in should))
    return query in own


def matches(index: Index, query: Query | None) -> DataFrame:
    """All documents that match, with all their columns; the caller aggregates. Each of several indexes is searched by its own postings."""
    if index.parts and any(_stored(p, query) for p in index.parts):
        each = [matches(p, query).withColumn("index_id", F.lit(p.name)) for p in index.parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each).select(*[f"`{c}`" for c in index.df.columns])
    return hits(index, query).df.select(*[f"`{c}`" for c in index.df.columns])


def count(index: Index, query: Query | None) -> DataFrame:
    return matches(index, query).agg(F.count("*").alias("count"))


def count_with(index: Index, query: Query | None, field: str) -> DataFrame:
    """Hits that have the field."""
    return matches(index, query).agg(F.count_if(_has(index, field)).alias("count"))


def any_with(index: Index, query: Query | None, field: str) -> DataFrame:
    return matches(index, query).agg(F.coalesce(F.max(_has(index, field)), F.lit(False)).alias("found"))


def ids(index: Index, query: Query | None) -> DataFrame:
    return matches(index, query).select(index.order).distinct()


def fields_present(index: Index, query: Query | None, candidates: list[str]) -> DataFrame:
    """(field, found) for every candidate, in one pass."""
    known = [c for c in candidates if c in index.fields]
    one = matches(index, query).agg(*[F.coalesce(F.max(_has(index, c)), F.lit(False)).alias(f"f{i}") for i, c in enumerate(known)])
    pairs = [F.struct(F.lit(c).alias("field"), (F.col(f"f{known.index(c)}") if c in known else F.lit(False)).alias("found")) for c in candidates]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.found")


def _has(index: Index, field: str) -> Column:
    f = index.fields[field]
    return F.size(index.values(f)) > 0 if f.multi else F.col(f"`{f.source}`").isNotNull()


def bm25(index: Index, query: Query) -> DataFrame:
    """The matches with their `score`; statistics come from all documents of the index.

    A term scores by its frequency, a phrase by its own, with the rarity of all its terms; prefixes,
    patterns, ranges, numbers and dates score 1 where they match. The parts of a clause count only
    where the clause itself matches, those of a negative one never. Boosts multiply.
    """
    terms = list(dict.fromkeys((f, t) for f, t, _ in Q.terms_of(query) if f in index.fields and not index.fields[f].is_number))
    names = list(dict.fromkeys(f for f, _ in terms))
    plain = index.df.columns
    if not terms:
        found = hits(index, query)
        return found.df.select(*[f"`{c}`" for c in plain], _score(query, index, found.known, {}, {}).alias("score"))
    stored = [n for n in names if index.fields[n].is_text and index.reads_postings([n])]
    rest = [n for n in names if n not in stored]
    found = hits(index, query, scored=True)
    known, tf, phrases, length, df = found.known, dict(found.tf), dict(found.phrases), dict(found.lengths), found.df
    stats: list[DataFrame] = []
    if stored:
        own = [(k, p) for k, p in enumerate(terms) if p[0] in stored]
        counts = index.inverted.of_terms([p for _, p in own]).groupBy("field", "term").agg(F.count("*").alias("df"))
        of = lambda n, c: F.max(F.when(F.col("field") == n, c))
        stats.append(index.inverted.statistics.agg(*[x for n in stored for x in (of(n, F.col("length") / F.col("docs")).alias(f"__avg{names.index(n)}"), of(n, F.col("docs")).cast("double").alias(f"__n{names.index(n)}"))]))
        stats.append(counts.agg(*[F.coalesce(F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("df"))), F.lit(0)).cast("double").alias(f"__df{k}") for k, (f, t) in own]))
    if rest:
        tokens = {n: F.col(f"__t{names.index(n)}") for n in rest}
        narrow = index.df.select(*[index.tokens(n).alias(f"__t{names.index(n)}") for n in rest])
        stats.append(
            narrow.agg(
                *[F.avg(F.nullif(F.size(c), F.lit(0))).alias(f"__avg{names.index(n)}") for n, c in tokens.items()],
                *[F.count_if(F.size(c) > 0).cast("double").alias(f"__n{names.index(n)}") for n, c in tokens.items()],
                *[F.count_if(F.array_contains(tokens[f], t)).cast("double").alias(f"__df{k}") for k, (f, t) in enumerate(terms) if f in tokens],
            )
        )
        df = df.withColumns({f"__t{names.index(n)}": index.tokens(n) for n in rest})
        tf |= {(f, t): F.size(tokens[f]) - F.size(F.array_remove(tokens[f], t)) for f, t in terms if f in tokens}
        length |= {n: F.size(c) for n, c in tokens.items()}
        phrases |= {q: phrase_count(token_places(tokens[q.field], q.terms), q) for q in leaves(query) if isinstance(q, Q.Phrase) and len(q.terms) > 1 and q.field in tokens}

    def idf(p: tuple[str, str]) -> Column:
        n, d = F.col(f"__n{names.index(p[0])}"), F.col(f"__df{terms.index(p)}")
        return F.log(1 + (n - d + 0.5) / (d + 0.5))

    def saturated(count: Column, field: str) -> Column:
        count = count.cast("double")
        return count / (count + K1 * (1 - B + B * length[field] / F.col(f"__avg{names.index(field)}")))

    parts = {}
    for q in leaves(query):
        if isinstance(q, _TERMS) and q.field in names:
            if q in phrases:
                parts[q] = reduce(lambda a, b: a + b, [idf((q.field, t)) for t in q.terms]) * saturated(phrases[q], q.field)
            else:
                each = [idf(p) * saturated(tf[p], p[0]) for p in _pairs(q)]
                parts[q] = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in each]) if each else F.lit(0.0)
    score = _score(query, index, known, parts, phrases)
    # One row each
    with_stats = reduce(lambda left, right: left.crossJoin(F.broadcast(right)), stats, df)
    return with_stats.select(*[f"`{c}`" for c in plain], score.alias("score"))


def _score(query: Query | None, index: Index, known: dict, parts: dict[Query, Column], phrases: dict) -> Column:
    zero = F.lit(0.0)
    if query in parts:
        return F.coalesce(parts[query], zero)
    if query is None or isinstance(query, Q.MatchNone):
        return zero
    if isinstance(query, Q.Boost):
        return F.lit(float(query.factor)) * _score(query.query, index, known, parts, phrases)
    if isinstance(query, Q.Bool):
        each = [_score(q, index, known, parts, phrases) for o, q in query.clauses if o != Q.MUST_NOT]
        return F.when(predicate(query, index, known), reduce(lambda a, b: a + b, each)).otherwise(zero) if each else zero
    return F.when(predicate(query, index, known), F.lit(1.0)).otherwise(zero)


def sort_columns(index: Index, sorts: list[str]) -> list[Column]:
    """Order for fields, `-field` for the reverse, `score` and `doc`; ties in ingest order.

    Absent strings come first and absent numbers count 0; of several values the least counts.
    """
    out = []
    for s in sorts:
        name, down = s.lstrip("-"), s.startswith("-")
        if name == "score":
            c = F.col("score")
            down = not down
        elif name == "doc":
            c = F.col(index.order)
        else:
            f = index.fields[name]
            # A value set only for sorting comes before the field's own
            at = F.coalesce(f"`_sort_{f.source}`", f"`{f.source}`") if f"_sort_{f.source}" in index.df.columns else F.col(f"`{f.source}`")
            c = F.array_min(at) if f.multi else at
            c = F.coalesce(c, F.lit(0).cast(f.data_type() if not f.multi else f.data_type().elementType)) if f.is_number else c
        out.append(F.desc_nulls_last(c) if down else F.asc_nulls_first(c))
    return [*out, F.asc(index.order)]


def top(index: Index, df: DataFrame, sorts: list[str], page: Page | None = None) -> DataFrame:
    """One page of df in order: a top-k per task, then of all."""
    page = page or Page()
    ordered = df.orderBy(*sort_columns(index, sorts))
    return ordered.limit(page.size * page.number).offset(page.first - 1) if page.number > 1 else ordered.limit(page.size)


@dataclass(frozen=True)
class Results:
    """A page of hits and how many there are in all."""

    page_df: DataFrame
    total_df: DataFrame
    page: Page

    def total(self) -> int:
        return self.total_df.first()[0]

    def is_empty(self) -> bool:
        return self.total() == 0

    def pages(self) -> int:
        return self.page.count(self.total())


def search(index: Index, query: Query, sorts: list[str] | None = None, page: Page | None = None, scores: bool = True) -> Results:
    """By score unless sorts are given, where `doc` alone means ingest order. Hits have their score whatever the order, unless `scores` is False."""
    sorts, page = sorts if sorts is not None else ["score"], page or Page()
    scored = scores or any(s.lstrip("-") == "score" for s in sorts)
    found = bm25(index, query) if scored else matches(index, query)
    return Results(top(index, found, sorts, page), count(index, query), page)


def render(df: DataFrame, longest: int = 1000) -> DataFrame:
    """Values as a result shows them: long texts left out, sortable date strings in fields named *date* as ISO."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            if "date" in f.name.lower():
                c = F.when(is_date_string(c), string_to_iso(c)).otherwise(c)
            c = F.when(F.length(f"`{f.name}`") < longest, c)
        out.append(c.alias(f.name))
    return df.select(*out)
