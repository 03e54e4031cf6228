"""Index definitions: which index a path belongs to, by templates with {name}."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = re.compile(r"[\w\-@$.]{1,255}")


def is_valid_index_name(name: str | None) -> bool:
    return bool(name and NAME.fullmatch(name))


def is_valid_name_column(name: Column) -> Column:
    """is_valid_index_name for a column; null for null."""
    return name.rlike(f"^{NAME.pattern}$")


@dataclass(frozen=True)
class Route:
    """An index name, fixed or with {name}, and the path of its content, with {name} in the same case."""

    name: str
    path: str
    excludes: tuple[str, ...] = ()

    @property
    def dynamic(self) -> bool:
        return "{name}" in self.name

    def __post_init__(self) -> None:
        if self.dynamic and "{name}" not in self.path:
            raise ValueError("a name with {name} needs a path with it")

    def pattern(self) -> str:
        head, _, tail = self.path.partition("{name}")
        # The last segment of a template may go on only at a slash
        return f"^{re.escape(head)}([^/]+?){re.escape(tail)}(?:/.*)?$" if self.dynamic else f"^{re.escape(self.path)}(?:/.*)?$"

    def _excluded(self) -> str | None:
        return "|".join("^" + re.escape(e).replace(r"\*", "[^/]*") + "(?:/.*)?$" for e in self.excludes) or None

    def index_of(self, path: str) -> str | None:
        found = re.match(self.pattern(), path)
        bad = self._excluded()
        if not found or (bad and re.match(bad, path)):
            return None
        return self.name.replace("{name}", found.group(1)) if self.dynamic else self.name

    def index_column(self, path: Column) -> Column:
        """index_of for a column."""
        hit = path.rlike(self.pattern())
        bad = self._excluded()
        hit = hit & ~path.rlike(bad) if bad else hit
        head, _, tail = self.name.partition("{name}")
        name = F.concat(F.lit(head), F.regexp_extract(path, self.pattern(), 1), F.lit(tail)) if self.dynamic else F.lit(self.name)
        return F.when(hit, name)

    def content_path(self, index: str) -> str | None:
        """The path of an index's content, or none if the index isn't of this route."""
        if not self.dynamic:
            return self.path if index == self.name else None
        head, _, tail = self.name.partition("{name}")
        if not (index.startswith(head) and index.endswith(tail) and len(index) > len(head) + len(tail)):
            return None
        return self.path.replace("{name}", index[len(head) : len(index) - len(tail)])

    def content_roots(self, folders: Sequence[str]) -> list[str]:
        return [f for f in folders if self.index_of(f) is not None]

    def clashes(self, other: Route | str) -> bool:
        """Whether both could name the same index, one template's part being the start of the other's."""
        a, b = self.name, other if isinstance(other, str) else other.name
        if not self.dynamic and "{name}" not in b:
            return a == b
        parts = lambda n: n.partition("{name}")[::2] if "{name}" in n else (n, "")
        (h1, t1), (h2, t2) = parts(a), parts(b)
        if "{name}" in a and "{name}" in b:
            return (h1.startswith(h2) or h2.startswith(h1)) and (t1.endswith(t2) or t2.endswith(t1))
        head, tail, fixed = (h1, t1, b) if "{name}" in a else (h2, t2, a)
        return len(fixed) > len(head) + len(tail) and fixed.startswith(head) and fixed.endswith(tail)


def file_filter(path: str, include: str | None = None, exclude: str | None = None, extensions: Sequence[str] = ()) -> bool:
    """Whether a relative path passes: an extension in any case, all of `include`, and not all of `exclude`."""
    if extensions and ("." not in path.rpartition("/")[2] or path.rpartition(".")[2].lower() not in extensions):
        return False
    return bool(not include or re.fullmatch(include, path)) and not (exclude and re.fullmatch(exclude, path))


def route(routes: Sequence[Route], path: Column) -> Column:
    """The index of the first route that takes a path."""
    return F.coalesce(*[r.index_column(path) for r in routes])
