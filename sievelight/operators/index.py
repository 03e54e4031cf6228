"""An index: a table of documents with typed fields over its columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_number, to_string
from ..schema import Catalog, Field
from .inverted import Inverted, Later, merge, placed_of, postings_of, shared_fields, texts_of


@dataclass(frozen=True)
class Index:
    """df with one row per document; `order` is the column of ingest order, which tells documents apart.

    inverted: the stored inverted index of its text fields, where there is one; queries on these
    fields then read postings instead of texts, with the same results. parts: the indexes that it is
    made of, where these are several.
    """

    df: DataFrame
    fields: dict[str, Field]
    order: str
    name: str = "index"
    inverted: Inverted | None = None
    parts: tuple[Index, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, order: str, *fields: Field, name: str = "index") -> Index:
        return cls(df, {f.name: f for f in fields}, order, name)

    @classmethod
    def from_catalog(cls, df: DataFrame, catalog: Catalog, order: str) -> Index:
        return cls(df, dict(catalog.fields), order, catalog.name)

    def values(self, field: Field) -> Column:
        """The values of a field as an array without nulls."""
        c = F.col(f"`{field.source}`")
        return F.filter(c, lambda x: x.isNotNull()) if field.multi else F.when(c.isNull(), F.array().cast(f"array<{field.data_type().simpleString()}>")).otherwise(F.array(c))

    def tokens(self, name: str) -> Column:
        """The terms of a field in order, those of several values one after the other.

        A date without a value has the empty term; numbers have no terms.
        """
        field = self.fields[name]
        c = F.col(f"`{field.source}`")
        if field.type == "date":
            if field.multi:
                return F.transform(self.values(field), lambda x: self._date_term(x, field))
            return F.array(F.coalesce(self._date_term(c, field), F.lit("")))
        if field.is_number:
            return F.array().cast("array<string>")
        if field.multi:
            return F.flatten(F.transform(self.values(field), field.terms_by.tokens))
        return field.terms_by.tokens(c)

    @staticmethod
    def _date_term(c: Column, field: Field) -> Column:
        return to_number(c, field.resolution).cast("string") if field.numeric else to_string(c, field.resolution)

    def terms(self, name: str) -> DataFrame:
        """(order column, term) for each distinct term of each document."""
        return self.df.select(F.col(self.order), F.explode(F.array_distinct(self.tokens(name))).alias("term"))

    def postings(self, names: Iterable[str]) -> DataFrame:
        """(field, term, doc, tf, positions, length): the inverted index of some fields."""
        names = list(names)
        if self.reads_postings(names):
            return self.inverted.postings.where(F.col("field").isin(*names)).select("field", "term", "doc", "tf", "positions", "length")
        return postings_of(placed_of(self.places(names)))

    def places(self, names: Iterable[str]) -> DataFrame:
        """(doc, field, terms): the terms of some fields in their order."""
        return texts_of(self.df, self.order, {n: self.tokens(n) for n in names})

    def reads_postings(self, names: Iterable[str]) -> bool:
        return self.inverted is not None and all(self.inverted.has(n) for n in names) and self.inverted.postings is not None

    def reads_dictionary(self, name: str) -> bool:
        return self.inverted is not None and self.inverted.has(name)

    def where(self, condition: Column) -> Index:
        """The documents for which a condition on their columns holds; the stored index goes on holding all."""
        return replace(self, df=self.df.where(condition), inverted=None, parts=())


def union(*indexes: Index) -> Index:
    """Several indexes as one: all their rows and fields, with the index's name in index_id."""
    df = indexes[0].df.withColumn("index_id", F.lit(indexes[0].name))
    fields = dict(indexes[0].fields)
    for i in indexes[1:]:
        df = df.unionByName(i.df.withColumn("index_id", F.lit(i.name)), allowMissingColumns=True)
        fields = {**i.fields, **fields}
    # Documents of several indexes may share a number, so only their dictionaries are taken together
    held = [i.inverted for i in indexes]
    inverted = Later(shared_fields(held), held[0].buckets, lambda: Inverted(None, (m := merge(held)).dictionary, m.statistics, m.fields, m.buckets)) if all(h is not None for h in held) else None
    return Index(df, fields, indexes[0].order, "+".join(i.name for i in indexes), inverted, tuple(indexes))
