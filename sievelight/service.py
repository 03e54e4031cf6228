"""The engine as a set of named indexes, with one method for each kind of request."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import KEYWORD
from .operators import facets as fc
from .operators import search as se
from .operators import terms as te
from .operators.index import Index, union
from .operators.store import ORD, IndexStore, fold_catalog, with_system_fields
from .operators.suggest import AutoSuggest, parse_weights
from .plans import nodes as Q
from .plans.language import SyntaxFault, parse_predicate
from .schema import Catalog
from .sources.folders import changes, listing
from .sources.routes import Route, is_valid_index_name


@dataclass(frozen=True)
class Config:
    """Settings that a deployment gives."""

    root: str = "indexes"
    debounce: str = "0 seconds"
    watch: bool = False
    watch_root: str | None = None
    watch_excludes: tuple[str, ...] = ()
    delay: str = "5 seconds"
    files_per_trigger: int = 100_000
    threads: int = 10
    extensions: tuple[str, ...] = ("psml",)
    routes: tuple[Route, ...] = ()
    stop_words: dict[str, bool] = field(default_factory=dict)
    files: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()

    @classmethod
    def from_keys(cls, keys: dict[str, str]) -> Config:
        """From keys index.root, index.types, index.extensions, index.NAME.name/path/excludes/no-stop-words/files.includes/files.excludes, threads.number, debounce and watcher.watch/root/max-folders/delay/excludes.

        A definition that can't be, or clashes with an earlier one, is left out and named in `ignored`.
        """
        listed = [t for t in keys.get("index.types", "").split(",") if t]
        names = listed or sorted({k.split(".")[1] for k in keys if k.startswith("index.") and k.endswith(".path")})
        split = lambda text: tuple(x for x in (text or "").split(",") if x)
        routes: list[Route] = []
        ignored = []
        for n in names:
            try:
                new = Route(keys.get(f"index.{n}.name", n), keys[f"index.{n}.path"], split(keys.get(f"index.{n}.excludes")))
            except (KeyError, ValueError):
                ignored.append(n)
                continue
            if any(new.clashes(r) for r in routes):
                ignored.append(n)
            else:
                routes.append(new)
        stop = {n: keys.get(f"index.{n}.no-stop-words") != "true" for n in names}
        files = {n: (keys.get(f"index.{n}.files.includes"), keys.get(f"index.{n}.files.excludes")) for n in names}
        return cls(
            keys.get("index.root", "indexes"), f"{int(keys.get('debounce', 0))} milliseconds", keys.get("watcher.watch", "false") == "true", keys.get("watcher.root"), split(keys.get("watcher.excludes")),
            f"{int(keys.get('watcher.delay', 5))} seconds", int(keys.get("watcher.max-folders", 100_000)), int(keys.get("threads.number", 10)), split(keys.get("index.extensions", "psml")), tuple(routes), stop, files, tuple(ignored),
        )


class Listener:
    """What an engine tells of its batches; override what is wanted."""

    def start_batch(self, batch: Batch) -> None:
        pass

    def warn(self, batch: Batch, message: str) -> None:
        pass

    def error(self, batch: Batch, error: Exception) -> None:
        pass

    def end_batch(self, batch: Batch) -> None:
        pass


class Recent(Listener):
    """Keeps the last batches."""

    def __init__(self, most: int = 200):
        self.batches: deque[Batch] = deque(maxlen=most)

    def start_batch(self, batch: Batch) -> None:
        self.batches.append(batch)


@dataclass
class Batch:
    """The progress of one indexing run."""

    index: str
    requester: str = ""
    total: int = 0
    current: int = 0
    started: float = field(default_factory=time.time)
    computed: float | None = None
    ended: float | None = None
    cancelled: bool = False
    version: int | None = None
    actions: dict[str, int] = field(default_factory=dict)
    problem: str | None = None

    @property
    def finished(self) -> bool:
        return self.ended is not None

    def compute_seconds(self) -> float | None:
        return None if self.computed is None else self.computed - self.started

    def index_seconds(self) -> float | None:
        return None if self.computed is None or self.ended is None else self.ended - self.computed

    def total_seconds(self) -> float:
        return (self.ended or time.time()) - self.started

    def as_dict(self) -> dict:
        return {"index": self.index, "requester": self.requester, "total": self.total, "current": self.current, "finished": self.finished, "cancelled": self.cancelled, "version": self.version, "seconds": self.total_seconds(), "problem": self.problem, **self.actions}


@dataclass
class Engine:
    """Indexes by name; a request names one, several separated by commas, or none for `default`.

    fetchers: sources of raw documents by content type, each called with (spark, paths) and giving what
    sources.fields_xml.read gives. mappings: by (content type, media type), DataFrame to DataFrame.
    """

    spark: SparkSession
    config: Config = field(default_factory=Config)
    indexes: dict[str, Index] = field(default_factory=dict)
    suggesters: dict[tuple, tuple[object, DataFrame]] = field(default_factory=dict)
    listener: Listener = field(default_factory=Listener)
    fetchers: dict[str, Callable] = field(default_factory=dict)
    mappings: dict[tuple[str, str], Callable] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    running: dict[str, Batch] = field(default_factory=dict)
    recent: Recent = field(default_factory=Recent)

    @classmethod
    def local(cls, spark: SparkSession, root: str, **settings) -> Engine:
        """An engine whose indexes lie under root, all that are there opened."""
        out = cls(spark, Config(root=root, **settings))
        out.open_all()
        return out

    def add(self, index: Index) -> Index:
        if not is_valid_index_name(index.name):
            raise ValueError(f"{index.name!r} can't name an index")
        self.indexes[index.name] = index
        return index

    def store(self, name: str, fields: dict | None = None) -> IndexStore:
        return IndexStore(self.spark, f"{self.config.root}/{name}", fields)

    def exists(self, name: str) -> bool:
        return is_valid_index_name(name) and self.store(name).exists()

    def create(self, name: str, catalog: Catalog | None = None) -> Index:
        """An index without documents, of the fields that a catalog has."""
        catalog = catalog or Catalog(name)
        store = self.store(name, dict(catalog.fields))
        store.publish(self.spark.createDataFrame([], catalog.schema()))
        store.save_catalog(catalog)
        return self.open(name)

    def open(self, name: str, order: str = ORD) -> Index:
        """The stored index of that name at its visible version, with its catalog and its postings."""
        catalog = self.store(name).load_catalog()
        if catalog is None:
            raise ValueError(f"{name} has no catalog")
        store = self.store(name, dict(catalog.fields))
        self.versions[name] = store.version()
        return self.add(replace(store.index(name, self.versions[name]), order=order))

    def open_all(self) -> list[str]:
        """Opens all indexes under the root that have a catalog, but those of suggesters."""
        at = IndexStore(self.spark, self.config.root)
        folders = [s.getPath().getName() for s in at._fs.listStatus(at._path(at.path)) if s.isDirectory()] if at._fs.exists(at._path(at.path)) else []
        names = sorted(n for n in folders if not n.endswith("_autosuggest") and is_valid_index_name(n) and self.store(n).load_catalog() is not None)
        for n in names:
            self.open(n)
        return names

    def etag(self, index: str | None = None) -> str:
        """A stamp of the visible versions of the indexes that a request names."""
        return "-".join(f"{n}.{self.store(n).version()}" for n in (index or "default").split(",") if n)

    def select(self, index: str | None = None) -> Index:
        names = [n for n in (index or "default").split(",") if n]
        missing = [n for n in names if n not in self.indexes]
        if missing:
            raise KeyError(f"no such index: {', '.join(missing)}")
        return self.indexes[names[0]] if len(names) == 1 else union(*[self.indexes[n] for n in names])

    # -------------------------------------------------------------- searches

    def basic_search(self, term: str, field: str = "fulltext", with_terms: str = "", facets: Sequence[str] = (), max_facets: int = 20, sort: Sequence[str] = (), page: int = 1, results: int = 100, index: str | None = None) -> tuple[se.Results, DataFrame | None]:
        """A phrase in a text field or a term in another, with further terms `f:v,..` that must hold, and facets of the hits."""
        at = self.select(index)
        known = at.fields.get(field)
        base: Q.Query = Q.Phrase.of(field, term) if known and known.is_text else Q.Term(field, term)
        extra = [Q.Term(*w.split(":", 1)) for w in with_terms.split(",") if ":" in w]
        query = Q.with_filters(base, *extra)
        found = se.search(at, query, list(sort) or None, se.Page(page, results))
        return found, fc.many(at, query, list(facets), max_facets) if facets else None

    def term_search(self, field: str, term: str, page: int = 1, results: int = 100, index: str | None = None) -> se.Results:
        return se.search(self.select(index), Q.Term(field, term), None, se.Page(page, results))

    def predicate_search(self, predicate: str, tokenize: bool = True, page: int = 1, index: str | None = None, default: str | None = None, keywords: bool = False) -> se.Results:
        """The full predicate syntax, in ingest order; without a default field every word names its own.

        keywords: words are terms as they are, not cut and put in lower case.
        """
        at = self.select(index)
        if tokenize and default is None and any(":" not in w for w in predicate.split() if w not in ("AND", "OR", "NOT") and '"' not in w):
            raise SyntaxFault("every word needs a field")
        return se.search(at, parse_predicate(predicate, default, KEYWORD if keywords else None), ["doc"], se.Page(page, 100))

    def get_facets(self, base: str | None = None, facets: Sequence[str] | None = None, max_number: int = 20, index: str | None = None, keywords: bool = False) -> DataFrame:
        """Facets of the named fields, or of all, under a base predicate whose default field is `type`."""
        if not base and not facets:
            raise ValueError("a base or facets are needed")
        query = parse_predicate(base, "type", KEYWORD if keywords else None) if base else None
        return fc.many(self.select(index), query, list(facets) if facets else None, max_number)

    def auto_suggest(self, term: str, fields: Sequence[str] = ("fulltext",), results: int = 10, terms: bool = False, return_fields: Sequence[str] = (), criteria_fields: Sequence[str] = (), criteria_values: Sequence[str] = (), weight: str = "", index: str | None = None) -> DataFrame:
        """Suggestions; the built table is kept until the index's version changes."""
        at = self.select(index)
        how = AutoSuggest(tuple(fields), terms, tuple(return_fields), criteria_fields[0] if criteria_fields else None, parse_weights(weight))
        key = (at.name, how.fields, how.terms, how.returned, how.criteria, tuple(how.weights.items()))
        # The version of what is stored; an index that isn't stored is its own stamp, and kept with it
        stamp: object = self.versions.get(at.name) or at.df
        if key not in self.suggesters or self.suggesters[key][0] is not stamp and not (isinstance(stamp, int) and self.suggesters[key][0] == stamp):
            self.suggesters[key] = stamp, how.build(at)
        return how.suggest(self.suggesters[key][1], term, criteria_values, results)

    def lookup_fuzzy(self, term: str, field: str = "keyword", index: str | None = None) -> DataFrame:
        return fc.bucket(te.fuzzy(self.select(index), field, term, swaps=True), 20, "term")

    def lookup_prefix(self, term: str, field: str = "keyword", index: str | None = None) -> DataFrame:
        return fc.bucket(te.prefixed(self.select(index), field, term, exact=False), 20, "term")

    def lookup_similar(self, term: str, fields: Sequence[str] = ("fulltext",), index: str | None = None) -> DataFrame:
        return te.similar(self.select(index), fields, term)

    def index_terms(self, field: str, index: str | None = None) -> DataFrame:
        return te.dictionary(self.select(index), field).orderBy("term")

    def index_summary(self, index: str | None = None, fields: bool = True) -> dict:
        at = self.select(index)
        out: dict = {"name": at.name, "documents": at.df.count()}
        return out | {"fields": te.fields(at)} if fields else out

    def catalog(self, index: str | None = None) -> list[dict]:
        return [{"name": f.name, "type": f.type, "stored": f.stored, "tokenized": f.is_text, "resolution": f.resolution.name if f.resolution else None, "doc_values": f.doc_values} for f in self.select(index).fields.values()]

    # -------------------------------------------------------------- ingest

    def index_folder(self, name: str, folder: str, regex: str | None = None, modified_after: str | None = None, ignore_index_date: bool = False, mapping=None, version: str | None = None, content_type: str = "default", requester: str = "") -> dict:
        """Brings a stored index up to date with a folder of XML field records; mapping, if any, changes the raw documents first.

        Files that are new or newer than their documents are read, no others, and documents whose file is
        gone leave. Fields that the catalog doesn't know yet are added to it. One run at a time for an index.
        """
        if name in self.running:
            raise RuntimeError(f"{name} is being indexed")
        batch = self.running[name] = Batch(name, requester)
        self.recent.start_batch(batch)
        self.listener.start_batch(batch)
        try:
            self._index_folder(batch, folder, regex, modified_after, ignore_index_date, mapping or self.mappings.get((content_type, "application/xml")), version, content_type)
        except Exception as e:
            batch.problem = repr(e)
            self.listener.error(batch, e)
            raise
        finally:
            batch.ended = time.time()
            del self.running[name]
            self.listener.end_batch(batch)
        return {"index": name, "version": batch.version, **batch.actions}

    def _index_folder(self, batch: Batch, folder: str, regex, modified_after, ignore_index_date: bool, mapping, version, content_type: str) -> None:
        from .operators.store import convert
        from .sources.fields_xml import definitions, read

        store = self.store(batch.index)
        files = listing(self.spark, folder, regex, modified_after)
        known = store.read().select(F.col("_src").alias("path"), F.col("_lastmodified").alias("modified")).distinct() if store.exists() else None
        todo = files.select("path", F.lit("insert").alias("action")) if known is None else changes(files, known)
        if known is not None and ignore_index_date:
            todo = files.select("path", F.lit("update").alias("action")).union(todo.where("action = 'delete'"))
        found = todo.collect()  # names of the files that changed
        fresh_paths = [r.path for r in found if r.action != "delete"]
        batch.total, batch.computed = len(found), time.time()
        batch.actions = {a: sum(r.action == a for r in found) for a in sorted({r.action for r in found})}
        catalog = store.load_catalog() or Catalog(batch.index)
        keys = self.spark.createDataFrame([(r.path,) for r in found], "_src string")
        new = None
        if fresh_paths:
            raw = (self.fetchers.get(content_type) or (lambda spark, paths: read(spark, paths, version)))(self.spark, fresh_paths)
            fresh = (mapping(raw) if mapping else raw).withColumn("__path", F.regexp_replace("file", "^file:/+", "file:/"))
            named = self.spark.createDataFrame([(p, "file:/" + p.removeprefix("file:").lstrip("/") if p.startswith("file:") else p) for p in fresh_paths], "src string, __path string")
            fresh = fresh.join(F.broadcast(named), "__path").drop("__path")  # names of the files that changed
            fresh = fresh.withColumn("__at", F.monotonically_increasing_id())
            for f in fold_catalog(definitions(fresh, "__at"), batch.index).fields.values():
                catalog.widen(f)
            typed, warned = convert(fresh.drop("__at"), catalog)
            for w in warned.distinct().limit(20).collect():
                self.listener.warn(batch, f"{w.name} can't be {w.value}")
            prefix = f"^file:/*{re.escape(folder.rstrip('/').removeprefix('file:').lstrip('/'))}"
            new = with_system_fields(typed, F.col("src"), F.regexp_replace("src", prefix, ""), F.col("modified")).drop("src", "file", "modified")
        store = self.store(batch.index, dict(catalog.fields))
        if not store.exists():
            batch.version = store.publish(new if new is not None else self.spark.createDataFrame([], catalog.schema()))
        elif found:
            batch.version = store.replace(keys, "_src", new)
        else:
            batch.version = store.version()
        store.save_catalog(catalog)
        batch.current = batch.total

    def check_progress(self, name: str) -> dict | None:
        """How far the run on an index is; none if none runs."""
        batch = self.running.get(name)
        return batch.as_dict() if batch else None

    def watch(self, name: str, folder: str, every: str | None = None, rounds: int | None = None, checkpoint: str | None = None):
        """Keeps a stored index up to date with a folder, deletes included; a running streaming query."""
        from .streaming.jobs import watch_folder

        known = None
        if self.exists(name):
            known = self.store(name).read().select(F.col("_src").alias("path"), F.col("_lastmodified").alias("modified")).distinct()
        return watch_folder(self.spark, folder, lambda _: self.index_folder(name, folder), known, None, every or self.config.delay, rounds, checkpoint)

    def clear_index(self, name: str) -> int:
        return self.store(name).clear()

    def delete_index(self, name: str) -> None:
        self.store(name).drop()
        self.indexes.pop(name, None)
        self.versions.pop(name, None)

    def dry_run(self, folder: str, version: str | None = None, mapping=None) -> DataFrame:
        """The documents that a folder would give, without storing them."""
        from .sources.fields_xml import read

        raw = read(self.spark, folder, version)
        return mapping(raw) if mapping else raw

    # -------------------------------------------------------------- administration

    def list_indexes(self) -> list[str]:
        return sorted(self.indexes)

    def list_definitions(self) -> list[Route]:
        return list(self.config.routes)

    def get_definition(self, name: str) -> Route | None:
        return next((r for r in self.config.routes if r.content_path(name) or r.name == name), None)

    def get_config(self) -> Config:
        return self.config

    def get_batches(self) -> list[dict]:
        return [b.as_dict() for b in self.recent.batches]

    def jobs_in_queue(self, jobs: DataFrame, index: str | None = None, requester: str | None = None) -> DataFrame:
        """The status of a table of jobs, by index, by requester, or all."""
        from .streaming.jobs import status

        return status(jobs, index, requester)

    def check_mappings(self, sample: DataFrame) -> dict[tuple[str, str], str | None]:
        """For each mapping what is wrong with it on raw documents like the sample; none where it is fine."""
        out: dict[tuple[str, str], str | None] = {}
        for key, mapping in self.mappings.items():
            try:
                out[key] = None if "fields" in mapping(sample).columns else "no column fields"
            except Exception as e:  # of a user's own mapping
                out[key] = f"{type(e).__name__}: {e}"
        return out

    def close(self) -> None:
        """Saves the catalogs of the open stored indexes and closes them all."""
        self.suggesters.clear()
        self.indexes.clear()
        self.versions.clear()
