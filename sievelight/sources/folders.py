"""Folders of files: listing, change detection, and translators by media type."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index

MEDIA = {"xml": "application/xml", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "txt": "text/plain", "md": "text/plain", "csv": "text/csv"}
#: Bytes of a binary file that a translator takes, at most; texts have no limit.
LARGEST = 30_000_000


def listing(spark: SparkSession, root: str, regex: str | None = None, after: str | None = None, content: bool = False) -> DataFrame:
    """(path, modified, length[, content]) of the files under root; contents are only read where asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if after:
        reader = reader.option("modifiedAfter", after)
    df = reader.load(root).select("path", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))
    return df.where(F.col("path").rlike(regex)) if regex else df


def changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action): insert, update or delete, from (path, modified) of files and of an index; what is as it was is left out."""
    both = files.select("path", F.col("modified").alias("now")).join(known.select("path", F.col("modified").alias("then")), "path", "full_outer")
    action = F.when(F.col("then").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("now") > F.col("then"), "update")
    return both.select("path", action.alias("action")).where("action is not null")


def existing(index: Index, folder: str, regex: str | None = None, path: str = "_path", modified: str = "_lastmodified") -> DataFrame:
    """(path, modified) of the documents under a folder whose path matches."""
    rows = index.df.where(F.col(path).startswith(folder))
    rows = rows.where(F.col(path).rlike(regex)) if regex else rows
    return rows.select(F.col(path).alias("path"), F.col(modified).alias("modified")).distinct()


def relative_path(root: str, path: str) -> str | None:
    """path below root, or none if it lies elsewhere."""
    root = root.rstrip("/")
    return path[len(root) :] or "/" if path == root or path.startswith(root + "/") else None


def relative_column(root: str, path: Column) -> Column:
    """relative_path for a column."""
    root = root.rstrip("/")
    return F.when(path == root, "/").when(path.startswith(root + "/"), F.substring(path, len(root) + 1, 1 << 30))


def media_type(path: str, media: dict[str, str] = MEDIA) -> str:
    """The media type of a file by its extension."""
    return media.get(path.rpartition(".")[2].lower(), "application/octet-stream")


class Translators:
    """Functions from bytes to text by media type; types that end in +xml are XML."""

    def __init__(self, largest: int = LARGEST) -> None:
        self.largest, self.media = largest, dict(MEDIA)
        self.by_type: dict[str, Callable[[bytes], str | None]] = {}
        self.binary: set[str] = set()
        for t in ("text/xml", "application/xml", "application/xhtml+xml", "text/plain", "text/csv"):
            self.register(t, lambda b: b.decode("utf-8", "replace"))
        self.register("text/html", lambda b: html_text(b.decode("utf-8", "replace")))

    def register(self, media: str, translate: Callable[[bytes], str | None], binary: bool = False) -> None:
        """binary: contents of more than `largest` bytes aren't translated."""
        self.by_type[media] = translate
        (self.binary.add if binary else self.binary.discard)(media)

    def get(self, media: str) -> Callable[[bytes], str | None] | None:
        return self.by_type.get(media) or (self.by_type["application/xml"] if media.endswith("+xml") else None)

    def translate(self, files: DataFrame) -> DataFrame:
        """(path, modified, media, text, problem) of files with contents; text is null where there is no translator, or where problem says why."""
        registry = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                media = b["path"].map(lambda p: media_type(p, registry.media))
                text, problem = zip(*[registry._one(m, c) for m, c in zip(media, b["content"])]) if len(b) else ((), ())
                yield pd.DataFrame({"path": b["path"], "modified": b["modified"], "media": media, "text": list(text), "problem": list(problem)})

        return files.select("path", "modified", "content").mapInPandas(run, "path string, modified timestamp, media string, text string, problem string")

    def _one(self, media: str, content: bytes) -> tuple[str | None, str | None]:
        translate = self.get(media)
        if translate is None:
            return None, "no translator"
        if media in self.binary and len(content) > self.largest:
            return None, f"more than {self.largest} bytes"
        try:
            return translate(content), None
        except Exception as e:  # of a user's own translator: the file is reported, the rest goes on
            return None, repr(e)


def html_text(page: str) -> str:
    """The visible text of a page."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.parts: list[str] = []
            self.hidden = 0

        def handle_starttag(self, tag: str, attrs: list) -> None:
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag: str) -> None:
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data: str) -> None:
            if not self.hidden:
                self.parts.append(data)

    r = Reader()
    r.feed(page)
    return re.sub(r"\s+", " ", " ".join(r.parts)).strip()
