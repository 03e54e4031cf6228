"""Analyzers: how a text becomes terms, as a Column and, for query texts, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]+"
_JOINED = r"[\p{L}\p{N}_]+(?:['’.:·](?=\p{L})[\p{L}\p{N}_]+|[.,](?=\p{N})[\p{N}]+)*"


@dataclass(frozen=True)
class Analyzer:
    """Terms are the matches of `pattern`, or the whole text where there is none."""

    name: str
    pattern: str | None
    lowercase: bool = True

    @property
    def tokenizes(self) -> bool:
        return self.pattern is not None

    def tokens(self, text: Column) -> Column:
        """The terms of a text in order, an empty array for null."""
        text = F.lower(text) if self.lowercase else text
        if self.pattern is None:
            return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
        return F.coalesce(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), F.array().cast("array<string>"))

    def terms(self, text: str) -> list[str]:
        text = text.lower() if self.lowercase else text
        return [text] if self.pattern is None else regex.findall(self.pattern, text)


#: Words of letters, digits and underscores in lower case; has a SQL counterpart.
STANDARD = Analyzer("standard", _WORD)
#: Like STANDARD, but keeps apostrophes, full stops and the like inside a word.
UNICODE = Analyzer("unicode", _JOINED)
WHITESPACE = Analyzer("whitespace", r"\S+", False)
KEYWORD = Analyzer("keyword", None, False)
LOWER_KEYWORD = Analyzer("lower_keyword", None)
ANALYZERS = {a.name: a for a in (STANDARD, UNICODE, WHITESPACE, KEYWORD, LOWER_KEYWORD)}


def split_values(text: str) -> list[str]:
    """Words and quoted phrases, the quotes kept."""
    return re.findall(r'"[^"]+"|\S+', text)


def is_valid_name(name: str | None) -> bool:
    return bool(name)


def filter_names(names: list[str]) -> list[str]:
    return [n for n in names if is_valid_name(n)]


def as_boost_map(names: list[str]) -> dict[str, float]:
    return {n: 1.0 for n in filter_names(names)}


def is_phrase(text: str) -> bool:
    return len(text) > 1 and text[0] == '"' == text[-1] and '"' not in text[1:-1]


def has_wildcards(text: str) -> bool:
    return "*" in text or "?" in text


def has_no_operators(text: str) -> bool:
    return " OR " not in text and " AND " not in text
