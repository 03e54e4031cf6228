"""The term dictionary: listing, frequencies, prefixes and near spellings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as Q
from ..plans.lower import glob_regex
from .facets import bucket
from .index import Index


def dictionary(index: Index, field: str) -> DataFrame:
    """(term, count): every term of a field with the number of its documents."""
    if index.reads_dictionary(field):
        return index.inverted.terms(field)
    return index.terms(field).groupBy("term").agg(F.count("*").alias("count"))


def values(index: Index, field: str) -> DataFrame:
    return dictionary(index, field).select("term").orderBy("term")


def fields(index: Index) -> list[str]:
    """Names of the fields that have terms."""
    return sorted(n for n, f in index.fields.items() if f.indexed and not f.is_number)


def doc_freq(index: Index, field: str, term: str) -> DataFrame:
    if index.reads_dictionary(field):
        return index.inverted.terms(field).where(F.col("term") == term).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return index.df.where(F.array_contains(index.tokens(field), term)).agg(F.count("*").alias("count"))


def doc_count(index: Index, field: str) -> DataFrame:
    if index.reads_dictionary(field):
        return index.inverted.statistics.where(F.col("field") == field).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("count"))
    return index.df.where(F.size(index.tokens(field)) > 0).agg(F.count("*").alias("count"))


def distance_with_swaps(a: str, b: str) -> int:
    """Edits between a and b, a swap of neighbours being one."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def fuzzy(index: Index, field: str, term: str, edits: int = 2, swaps: bool = False) -> DataFrame:
    """(term, count): other terms within `edits` edits.

    With swaps, a swap counts one: candidates are within twice the plain edits, and only they reach Python.
    """
    near = dictionary(index, field).where((F.col("term") != term) & F.levenshtein("term", F.lit(term), edits * (2 if swaps else 1)).between(1, edits * (2 if swaps else 1)))
    if not swaps:
        return near

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[distance_with_swaps(t, term) <= edits for t in b["term"]]]

    return near.mapInPandas(keep, near.schema)


def prefixed(index: Index, field: str, prefix: str, exact: bool = True) -> DataFrame:
    """(term, count): terms with a prefix, with or without the prefix itself."""
    found = dictionary(index, field).where(F.col("term").startswith(prefix))
    return found if exact else found.where(F.col("term") != prefix)


def similar(index: Index, names: Sequence[str], term: str, size: int = 20) -> DataFrame:
    """(term, count): near spellings and longer terms of several fields, each pair of term and count once."""
    out: DataFrame | None = None
    for n in names:
        part = fuzzy(index, n, term, swaps=True).union(prefixed(index, n, term, exact=False))
        out = part if out is None else out.union(part)
    return bucket(out.distinct(), size, "term")


def pairs(names: Sequence[str], texts: Sequence[str]) -> list[tuple[str, str]]:
    return [(n, t) for n in names for t in texts]


def extract(query: Q.Query, index: Index) -> DataFrame:
    """(field, term): the terms of a query, patterns replaced by the dictionary terms that they match."""
    spark = index.df.sparkSession
    plain = [(f, t) for f, t, _ in Q.terms_of(query)]
    out = spark.createDataFrame(plain, "field string, term string")
    for node in _walk(query):
        if isinstance(node, (Q.Prefix, Q.Wildcard, Q.Fuzzy)) and node.field in index.fields:
            words = dictionary(index, node.field).select("term")
            if isinstance(node, Q.Prefix):
                words = words.where(F.col("term").startswith(node.prefix))
            elif isinstance(node, Q.Wildcard):
                words = words.where(F.col("term").rlike(glob_regex(node.pattern)))
            else:
                words = words.where(F.levenshtein("term", F.lit(node.text), node.edits).between(0, node.edits))
            out = out.union(words.select(F.lit(node.field), "term"))
    return out.distinct()


def _walk(query: Q.Query) -> Iterator[Q.Query]:
    yield query
    if isinstance(query, Q.Boost):
        yield from _walk(query.query)
    if isinstance(query, Q.Bool):
        for occur, q in query.clauses:
            if occur != Q.MUST_NOT:
                yield from _walk(q)
