"""Suggestions: prefix queries over a dictionary, autosuggestion, and queries for similar documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import STANDARD, Analyzer, split_values
from ..plans import nodes as Q
from .index import Index
from .search import bm25, hits


def suggestion_predicate(index: Index, words: Sequence[tuple[str, str]], condition: Q.Query | None = None, union: bool = True) -> DataFrame:
    """Documents with terms that begin with the words (field, prefix).

    union: any word does. Otherwise every word has to, in any of its fields, but words that begin no
    term of the index don't count; if that is all of them, nothing matches. The condition always holds.
    """
    from .terms import dictionary

    by_word: dict[str, list[Q.Query]] = {}
    for f, p in words:
        if f in index.fields:
            by_word.setdefault(p, []).append(Q.Prefix(f, p))
    if not by_word:
        return index.df.limit(0)
    tests = {p: Q.any_of(*qs) for p, qs in by_word.items()}
    required = [condition] if condition is not None else []
    if union:
        return hits(index, Q.all_of(Q.any_of(*tests.values()), *required)).df.select(*[f"`{c}`" for c in index.df.columns])
    # Which words begin any term at all: one row from each field's dictionary
    alive = [any(dictionary(index, q.field).where(F.col("term").startswith(p)).limit(1).count() for q in by_word[p]) for p in tests]
    kept = [q for q, a in zip(tests.values(), alive) if a]
    if not kept:
        return index.df.limit(0)
    return hits(index, Q.all_of(*kept, *required)).df.select(*[f"`{c}`" for c in index.df.columns])


def suggestion_query(index: Index, words: Sequence[tuple[str, str]], condition: Q.Query | None = None, most: int = 1024) -> tuple[Q.Query, bool]:
    """The same as a scored query: a disjunction of the terms, the word itself counting twice; and whether `most` cut it short."""
    from .terms import dictionary

    parts: list[Q.Query] = []
    cut_short = False
    for f, p in words:
        if f not in index.fields:
            continue
        terms = [r.term for r in dictionary(index, f).where(F.col("term").startswith(p)).orderBy("term").limit(most + 1).collect()]  # a query's clauses
        cut_short |= len(terms) > most
        parts += [Q.boosted(Q.Term(f, t), 2.0 if t == p else 1.0) for t in terms[:most]]
    query = Q.any_of(*parts)
    return (Q.all_of(query, condition) if condition is not None else query), cut_short


def weight(df: DataFrame, weights: dict[str, float]) -> Column:
    """Hundredths of the weighted sum: a missing value counts 1, one that is no number 0; no weight at all means 100."""
    if not weights:
        return F.lit(100).cast("bigint")
    def part(name: str, w: float) -> Column:
        c = F.col(f"`{name}`")
        return F.lit(w) * F.when(c.isNull(), F.lit(1.0)).otherwise(F.coalesce(c.try_cast("float").cast("double"), F.lit(0.0)))

    total = reduce(lambda a, b: a + b, [part(n, w) for n, w in weights.items()])
    return F.when(total == 0, F.lit(100)).otherwise((total * 100).cast("bigint")).cast("bigint")


def parse_weights(text: str) -> dict[str, float]:
    """'field:weight,...'; what can't be read is left out."""
    out = {}
    for part in (text or "").split(","):
        name, _, value = part.partition(":")
        try:
            out[name.strip()] = float(value) if value else 1.0
        except ValueError:
            continue
    return {k: v for k, v in out.items() if k}


@dataclass(frozen=True)
class AutoSuggest:
    """Suggestions from terms, or from stored values with weights, contexts and further fields to return.

    The key of a cached one is all of these options.
    """

    fields: tuple[str, ...]
    terms: bool = False
    returned: tuple[str, ...] = ()
    criteria: str | None = None
    weights: dict[str, float] = field(default_factory=dict)
    analyzer: Analyzer = STANDARD
    least_chars: int = 2

    def build(self, index: Index) -> DataFrame:
        """(doc, text, tokens, weight, contexts, payload): one row for each value, or term."""
        contexts = index.tokens(self.criteria) if self.criteria else F.array().cast("array<string>")
        payload = F.create_map(*[x for n in self.returned for x in (F.lit(n), F.col(f"`{index.fields[n].source}`").cast("string"))]) if self.returned else F.create_map().cast("map<string,string>")
        if self.terms:
            from .terms import dictionary

            terms = reduce(lambda a, b: a.union(b), [dictionary(index, f).select(F.col("term").alias("text")) for f in self.fields])
            terms = terms.distinct() if len(self.fields) > 1 else terms
            return terms.select(F.lit(None).cast("bigint").alias("doc"), "text", F.array("text").alias("tokens"), F.lit(1).cast("bigint").alias("weight"), F.array().cast("array<string>").alias("contexts"), F.create_map().cast("map<string,string>").alias("payload"))
        each = F.flatten(F.array(*[index.values(index.fields[f]) for f in self.fields]))
        rows = index.df.select(F.col(index.order).alias("doc"), F.explode(each).alias("text"), weight(index.df, self.weights).alias("weight"), contexts.alias("contexts"), payload.alias("payload"))
        return rows.select("doc", "text", self.analyzer.tokens(F.col("text")).alias("tokens"), "weight", "contexts", "payload")

    def suggest(self, built: DataFrame, text: str, contexts: Sequence[str] = (), size: int = 10) -> DataFrame:
        """The heaviest suggestions whose tokens include all words but the last, and one that begins with the last."""
        words = self.analyzer.terms(text)
        if not words or len(text.strip()) < self.least_chars:
            return built.limit(0).select("text", F.lit("").alias("highlight"), "weight", "doc", "payload")
        *whole, start = words
        test = F.exists("tokens", lambda t: t.startswith(start))
        for w in whole:
            test = test & F.array_contains("tokens", w)
        if contexts:
            test = test & F.arrays_overlap("contexts", F.array(*[F.lit(c) for c in contexts]))
        found = built.where(test)
        # The parts of the text that were typed, marked; a lookbehind keeps to the starts of words
        pattern = "(?iu)(?<![\\p{L}\\p{N}_])(" + "|".join([*[f"{w}(?![\\p{{L}}\\p{{N}}_])" for w in whole], start]) + ")"
        marked = F.regexp_replace("text", F.lit(pattern), F.lit("<b>$1</b>"))
        top = found.select("text", marked.alias("highlight"), "weight", "doc", "payload").orderBy(F.desc("weight"), "text", "doc").limit(size)
        return top.dropDuplicates(["text", "highlight", "doc"]).orderBy(F.desc("weight"), "text", "doc")


def similar_queries(index: Index, query: Q.Query, edits: int = 2) -> list[Q.Query]:
    """The query with one of its terms replaced by a near spelling that the index has, for each such spelling."""
    from .terms import fuzzy

    out: list[Q.Query] = []
    for f, t in dict.fromkeys((f, t) for f, t, _ in Q.terms_of(query)):
        if f in index.fields:
            out += [Q.substitute(query, f, t, r.term) for r in fuzzy(index, f, t, edits).orderBy("term").toLocalIterator()]
    return out


def similar_questions(index: Index, question, most: int = 50) -> list:
    """The question without its quotes, where it has any; else with one word replaced by a near spelling from any of its fields."""
    from dataclasses import replace

    from .terms import fuzzy

    if '"' in question.text:
        return [replace(question, text=question.text.replace('"', " "))]
    out: list = []
    for word in split_values(question.text):
        known = [f for f in question.fields if f in index.fields]
        near = reduce(lambda a, b: a.union(b), [fuzzy(index, f, word).select("term") for f in known]) if known else None
        terms = [r.term for r in near.distinct().orderBy("term").limit(most - len(out)).collect()] if near is not None else []  # `most` is the feature's
        out += [replace(question, text=question.text.replace(word, t)) for t in terms]
        if len(out) >= most:
            break
    return out


def similar_query(index: Index, doc: object, fields: Sequence[str], most_terms: int = 25, least_tf: int = 1, least_df: int = 1) -> Q.Query:
    """A query of the weightiest terms of one document: its own frequency times rarity in the index."""
    from .terms import dictionary

    own = index.where(F.col(index.order) == doc)
    parts: list[Q.Query] = []
    for f in fields:
        tf = own.df.select(F.explode(index.tokens(f)).alias("term")).groupBy("term").agg(F.count("*").alias("tf")).where(F.col("tf") >= least_tf)
        df = dictionary(index, f).join(F.broadcast(tf), "term").select("term", "tf", F.col("count").alias("df")).where(F.col("df") >= least_df)  # the terms of one document
        n = index.df.agg(F.count("*").alias("n"))
        score = F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
        top = df.crossJoin(F.broadcast(n)).orderBy(score.desc(), "term").limit(most_terms).collect()  # a query's clauses
        parts += [Q.Term(f, r.term) for r in top]
    return Q.any_of(*parts)


def similar_documents(index: Index, doc: object, fields: Sequence[str], most_terms: int = 25) -> DataFrame:
    """Other documents by the score of similar_query."""
    return bm25(index, similar_query(index, doc, fields, most_terms)).where(F.col(index.order) != doc)
