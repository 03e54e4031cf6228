"""Fields, and the catalog that holds the first definition of each."""

from __future__ import annotations

import json
import re
import string
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .functions.analysis import KEYWORD, STANDARD, Analyzer
from .functions.dates import Resolution

NUMERIC = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
INDEX_OPTIONS = ("none", "docs", "docs-and-freqs", "docs-and-freqs-and-positions", "docs-and-freqs-and-positions-and-offsets")
DOC_VALUES = ("none", "sorted", "sorted-set", "sorted-numeric", "forced-none")


@dataclass(frozen=True)
class Field:
    """A field of an index over a column of a table.

    type: text, keyword, int, long, float, double or date. A date has a resolution and is compared
    as a string of digits, or as a number where `numeric` is set. multi: the column is an array.
    """

    name: str
    type: str = "text"
    column: str | None = None
    analyzer: Analyzer = STANDARD
    resolution: Resolution | None = None
    numeric: bool = False
    multi: bool = False
    stored: bool = True
    indexed: bool = True
    doc_values: str = "none"
    date_format: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def is_text(self) -> bool:
        return self.type == "text"

    @property
    def is_number(self) -> bool:
        return self.type in NUMERIC

    @property
    def terms_by(self) -> Analyzer:
        return self.analyzer if self.is_text else KEYWORD

    def without_doc_values(self) -> Field:
        return replace(self, doc_values="forced-none")

    def data_type(self) -> T.DataType:
        one = NUMERIC.get(self.type) or (T.TimestampType() if self.type == "date" else T.StringType())
        return T.ArrayType(one) if self.multi else one


def parse_index(text: str | None) -> str:
    """An index option by its name; the fullest for no name, none for an unknown one."""
    name = (text or INDEX_OPTIONS[-1]).lower().replace("_", "-")
    return name if name in INDEX_OPTIONS else "none"


def parse_date_format(text: str | None) -> str | None:
    """A date format, if all its letters outside quotes stand for parts of a date; none otherwise."""
    if not text or text.count("'") % 2:
        return None
    return text if set(re.sub(r"'[^']*'", "", text)) & set(string.ascii_letters) <= set("GyYMLwWDdFEuaHkKhmsSzZXVOQqe") else None


def parse_numeric(text: str | None) -> str | None:
    return text.lower() if text and text.lower() in NUMERIC else None


def parse_doc_values(text: str | None, numeric: bool) -> str:
    name = (text or "none").lower().replace("_", "-")
    if name == "sorted" and numeric:
        return "sorted-numeric"
    return name if name in DOC_VALUES else "none"


def _same(a: Field, b: Field) -> bool:
    """Equal but for the resolution, and for doc values where one of them has none."""
    loose = {a.doc_values, b.doc_values} & {"none", "forced-none"}
    alike = lambda f: replace(f, resolution=None, doc_values="none" if loose else f.doc_values, column=None)
    return alike(a) == alike(b)


@dataclass
class Catalog:
    """Definitions of fields in the order in which they were first seen."""

    name: str = "catalog"
    fields: dict[str, Field] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def register(self, new: Field) -> Field:
        """The definition that holds: the first one; a later one that differs is rewritten, with a warning."""
        if not new.indexed:
            return new
        old = self.fields.setdefault(new.name, new)
        if not _same(old, new):
            self.warnings.append(f"field {new.name} was defined otherwise before")
            warnings.warn(self.warnings[-1], stacklevel=2)
            return old
        return replace(old, doc_values=new.doc_values) if new.doc_values == "forced-none" else old

    def widen(self, new: Field) -> Field:
        """register, for which a field has several values as soon as one definition has."""
        old = self.fields.get(new.name)
        if old is not None and old.multi != new.multi:
            self.fields[new.name], new = replace(old, multi=True), replace(new, multi=True)
        return self.register(new)

    def is_tokenized(self, name: str) -> bool:
        return name in self.fields and self.fields[name].is_text

    def numeric_type(self, name: str) -> str | None:
        f = self.fields.get(name)
        return f.type if f and f.is_number else None

    def resolution(self, name: str) -> Resolution | None:
        f = self.fields.get(name)
        return f.resolution if f else None

    def by_prefix(self, prefix: str) -> list[str]:
        return [n for n in self.fields if n.startswith(prefix)]

    def schema(self) -> T.StructType:
        """Columns of a table of all the fields, their definitions in the metadata."""
        return T.StructType([T.StructField(f.name, f.data_type(), True, self._entry(f)) for f in self.fields.values()])

    @staticmethod
    def _entry(f: Field) -> dict:
        return {"name": f.name, "type": f.type, "analyzer": f.analyzer.name, "resolution": f.resolution.name if f.resolution else None, "numeric": f.numeric, "multi": f.multi, "stored": f.stored, "doc_values": f.doc_values, "date_format": f.date_format}

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [self._entry(f) for f in self.fields.values()]})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        from .functions.analysis import ANALYZERS

        data = json.loads(text)
        out = cls(data["name"])
        for e in data["fields"]:
            out.register(Field(**{**e, "analyzer": ANALYZERS[e["analyzer"]], "resolution": Resolution.of(e["resolution"])}))
        return out
