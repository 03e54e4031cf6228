"""Index storage: segments of documents with their inverted index, tombstones, and manifests.

A change writes only what is new: a segment of documents with the postings of its text fields, and a
list of the documents that it takes away. A manifest, one file for each version, then names all that
is visible; readers keep the version that they opened, and a writer that is lost leaves no trace but
files that no manifest names. Two writers at once can't both create the same version: the later one
is told so. Every document has a number, _ord, that is given once, when it's written, and never again.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import Resolution
from ..schema import NUMERIC, Catalog, Field
from . import inverted as inv
from .index import Index

FORMAT = 3
#: Blocks of 64 documents, with which of them went, that are sent to all tasks at most.
BLOCKS = 1_000_000
ORD = "_ord"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; in local mode one of this machine if none is named."""
    import re
    import tempfile

    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or (context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    held = tempfile.mkdtemp(prefix="sievelight-")
    context.setCheckpointDir(held)
    return context.getCheckpointDir()


class IndexStore:
    """A table of documents under `path`, any file system that Spark can reach.

    fields: the definitions of its fields; those of texts get an inverted index. key: the column by
    which upsert replaces documents.
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Field] | None = None):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.last_used = time.time()

    # -------------------------------------------------------------- files

    def _read_text(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; an error if it is there already."""
        new, at = self._path(f"{self.path}/.{name}.{time.time_ns()}"), self._path(f"{self.path}/{name}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise FileExistsError(f"{self.path}/{name} was made by another writer")

    def _numbers(self, prefix: str) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[len(prefix) : -5]) for n in names if n.startswith(prefix) and n.endswith(".json"))

    # -------------------------------------------------------------- versions

    def version(self) -> int:
        """The visible version; 0 if there is none."""
        return max(self._numbers("manifest-"), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def manifest(self, version: int | None = None) -> dict:
        number = version or self.version()
        text = self._read_text(f"manifest-{number:08d}.json")
        if text is None:
            raise FileNotFoundError(f"{self.path} has no version {number}")
        out = json.loads(text)
        if out["format"] != FORMAT:
            raise ValueError(f"{self.path} has format {out['format']}, not {FORMAT}")
        return out

    def _visible(self, segments: list[dict], tombstones: list[str], next_ord: int) -> int:
        number = self.version() + 1
        self._create(f"manifest-{number:08d}.json", json.dumps({"format": FORMAT, "segments": segments, "tombstones": tombstones, "next_ord": next_ord, "at": time.time()}))
        self.last_used = time.time()
        return number

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version as they were written; index() has their numbers, too."""
        m = self.manifest(version)
        self.last_used = time.time()
        return self._documents(m).drop("_seg", ORD)

    def _documents(self, m: dict) -> DataFrame:
        if not m["segments"]:
            raise ValueError(f"{self.path} has no segment")
        parts = [self._widened(self.spark.read.parquet(f"{self.path}/{s['name']}/docs")).withColumn("_seg", F.lit(s["number"])) for s in m["segments"]]
        docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        gone = self._tombstones(m)
        return docs if gone is None else docs.join(gone, (docs[ORD] == gone["__gone"]) & (docs["_seg"] <= gone["__upto"]), "left_anti")

    def _widened(self, docs: DataFrame) -> DataFrame:
        """A segment that was written before a field had several values has it as arrays of one."""
        many = {f.source for f in (self.fields or {}).values() if f.multi}
        return docs.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), F.array(f"`{f.name}`")).alias(f.name) if f.name in many and not isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in docs.schema])

    def _tombstones(self, m: dict) -> DataFrame | None:
        if not m["tombstones"]:
            return None
        return self.spark.read.parquet(*[f"{self.path}/{t}" for t in m["tombstones"]]).select(F.col("ord").alias("__gone"), F.col("upto").alias("__upto"))

    def index(self, name: str = "index", version: int | None = None) -> Index:
        """The documents as an index, with stored postings where all segments have them."""
        m = self.manifest(version)
        fields = self.fields or {}
        docs = self._documents(m)
        texts = [n for n, f in fields.items() if f.is_text and f.indexed and all(n in s["texts"] for s in m["segments"])]
        found = None
        if texts:
            gone = self._tombstones(m)
            parts = []
            for s in m["segments"]:
                one = inv.Inverted.read(self.spark, f"{self.path}/{s['name']}", texts, s["buckets"])
                if gone is not None:
                    # Frequencies follow from what is left, as the documents that went still stand in the files
                    left = without_gone(one.postings, gone.where(F.col("__upto") >= s["number"]).select("__gone"))
                    one = inv.Inverted(left, inv.dictionary_of(left), inv.statistics_of(left), one.fields, one.buckets)
                parts.append(one)
            found = inv.merge(parts)
        return Index(docs.drop("_seg"), fields, ORD, name, found)

    # -------------------------------------------------------------- changes

    def _segment(self, df: DataFrame, m: dict | None, keep_ord: bool = False) -> tuple[dict, int]:
        """Writes a segment of df; its entry for the manifest, and the next free number."""
        number = 1 + max([s["number"] for s in m["segments"]] if m else [], default=0)
        base = m["next_ord"] if m else 0
        name = f"s{number:06d}-{time.time_ns()}"
        rows = df if keep_ord else df.drop(ORD, "_seg").select("*", (F.lit(base) + F.monotonically_increasing_id()).alias(ORD))
        rows.write.parquet(f"{self.path}/{name}/docs")
        made = self.spark.read.parquet(f"{self.path}/{name}/docs")
        fields = {n: f for n, f in (self.fields or {}).items() if f.is_text and f.indexed and f.source in made.columns}
        buckets = inv.buckets_for(made)
        if fields:
            index = Index(made, fields, ORD)
            inv.write(index.places(fields), f"{self.path}/{name}", buckets)
        most = made.agg(F.max(ORD)).first()[0]
        return {"name": name, "number": number, "texts": sorted(fields), "buckets": buckets}, max(base, base if most is None else most + 1)

    def _bury(self, rows: DataFrame, m: dict) -> str:
        """Writes (ord, upto) of documents that go; only they are written, whatever the size of the index."""
        upto = max(s["number"] for s in m["segments"])
        name = f"t{upto:06d}-{time.time_ns()}"
        rows.select(F.col(ORD).alias("ord"), F.lit(upto).alias("upto")).write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, df: DataFrame) -> int:
        """df as all of the index."""
        m = self.manifest() if self.exists() else None
        segment, following = self._segment(df, m)
        return self._visible([segment], [], following)

    def append(self, new: DataFrame) -> int:
        m = self.manifest() if self.exists() else None
        segment, following = self._segment(new, m)
        return self._visible([*(m["segments"] if m else []), segment], m["tombstones"] if m else [], following)

    def upsert(self, new: DataFrame, key: str | None) -> int:
        """Replaces the documents whose key is among the new ones; without a key it appends."""
        if key is None or not self.exists():
            return self.append(new)
        return self.replace(new.select(key), key, new)

    def replace(self, keys: DataFrame, key: str, new: DataFrame | None = None) -> int:
        """Takes away the documents whose `key` is among keys and adds the new ones, in one version."""
        m = self.manifest()
        old = self._documents(m)
        gone = old.select(ORD, F.col(f"`{key}`").alias("__key")).join(keys.select(F.col(f"`{key}`").alias("__key")).where("__key is not null").distinct(), "__key", "left_semi")
        buried = self._bury(gone, m)
        segments, following = m["segments"], m["next_ord"]
        if new is not None:
            segment, following = self._segment(new, m)
            segments = [*segments, segment]
        return self._visible(segments, [*m["tombstones"], buried], following)

    def delete(self, condition: Column) -> int:
        """Without the documents for which the condition holds."""
        m = self.manifest()
        buried = self._bury(self._documents(m).where(condition), m)
        return self._visible(m["segments"], [*m["tombstones"], buried], m["next_ord"])

    def delete_matching(self, query, name: str = "index") -> int:
        """Without the documents that a query matches, or a term."""
        from .search import matches

        m = self.manifest()
        buried = self._bury(matches(self.index(name), query), m)
        return self._visible(m["segments"], [*m["tombstones"], buried], m["next_ord"])

    def clear(self) -> int:
        m = self.manifest()
        segment, following = self._segment(self._documents(m).drop("_seg").limit(0), m)
        return self._visible([segment], [], following)

    def update(self, condition: Column, column: str, value: Column) -> int:
        """The value by which a column sorts, for the documents for which the condition holds.

        What is searched and shown stays: the value goes to a column of its own, which orders read
        (search.sort_columns). Only the documents that it concerns are written again.
        """
        m = self.manifest()
        docs = self._documents(m).drop("_seg")
        own = sort_column(column)
        now = F.col(f"`{own}`") if own in docs.columns else F.col(f"`{column}`")
        hit = docs.where(condition).withColumn(own, value.cast(docs.schema[column].dataType)) if own not in docs.columns else docs.where(condition).withColumn(own, value.cast(docs.schema[own].dataType))
        segment, following = self._segment(hit.withColumn(own, F.coalesce(own, now)), m, keep_ord=True)
        buried = self._bury(hit, m)
        return self._visible([*m["segments"], segment], [*m["tombstones"], buried], following)

    def compact(self) -> int:
        """All that is visible as one segment, without tombstones; documents keep their numbers."""
        m = self.manifest()
        segment, following = self._segment(self._documents(m).drop("_seg"), m, keep_ord=True)
        return self._visible([segment], [], max(following, m["next_ord"]))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and the files that none of those names."""
        held = self._numbers("manifest-")
        old, left = held[:-keep], [self.manifest(v) for v in held[-keep:]]
        named = {s["name"] for m in left for s in m["segments"]} | {t for m in left for t in m["tombstones"]}
        for v in old:
            self._fs.delete(self._path(f"{self.path}/manifest-{v:08d}.json"), False)
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name[:1] in "st" and name[1:7].isdigit() and name not in named:
                self._fs.delete(s.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    # -------------------------------------------------------------- catalog

    def save_catalog(self, catalog: Catalog) -> None:
        """As the next of the catalogs; the last one counts."""
        number = max(self._numbers("catalog-"), default=0) + 1
        self._create(f"catalog-{number:08d}.json", catalog.to_json())

    def load_catalog(self) -> Catalog | None:
        number = max(self._numbers("catalog-"), default=0)
        return Catalog.from_json(self._read_text(f"catalog-{number:08d}.json")) if number else None


def sort_column(column: str) -> str:
    """The column that holds what a field sorts by, where that differs from its value."""
    return f"_sort_{column}"


def without_gone(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of the documents in __gone.

    These are sent to all tasks as bits, so that postings needn't go through an exchange by document;
    of more blocks than BLOCKS they do.
    """
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    blocks = gone.groupBy(F.shiftright("__gone", 6).alias("__block")).agg(F.bit_or(bit("__gone")).alias("__bits"))
    if gone.count() > BLOCKS and blocks.count() > BLOCKS:
        return postings.join(gone.select(F.col("__gone").alias("doc")).distinct(), "doc", "left_anti")
    met = postings.join(F.broadcast(blocks), F.shiftright("doc", 6) == F.col("__block"), "left")
    return met.where(F.col("__bits").isNull() | (F.col("__bits").bitwiseAND(bit("doc")) == 0)).drop("__block", "__bits")


def without(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new; rows without a key stay."""
    return old.join(new.select(F.col(f"`{key}`").alias("__key")).distinct(), F.col(f"`{key}`") == F.col("__key"), "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return without(old, new, key).unionByName(new, allowMissingColumns=True)


def updated(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, value).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def convert(raw: DataFrame, catalog: Catalog, fields: str = "fields") -> tuple[DataFrame, DataFrame]:
    """Raw documents, an array of (name, value) structs, as typed columns; and (name, value) of what couldn't be read.

    A number that can't be read leaves its field out, a date becomes the empty date, and the document
    stays. A date with a time is read in its own time zone, where the field has one. Dates are UTC, so
    the session's time zone has to be.
    """
    zoned = any(c.name == "timezone" for c in raw.schema[fields].dataType.elementType)

    def own(f: Field) -> Column:
        return F.filter(fields, lambda x: x["name"] == f.name)

    def typed(f: Field, v: Column, x: Column) -> Column:
        if f.is_number:
            return v.try_cast(NUMERIC[f.type])
        if f.type == "date":
            at = F.try_to_timestamp(v, F.lit(f.date_format or "yyyy-MM-dd"))
            return F.to_utc_timestamp(at, F.coalesce(x["timezone"], F.lit("UTC"))) if zoned else at
        return v

    def read_as(f: Field) -> Column:
        values = F.transform(own(f), lambda x: typed(f, F.coalesce(x["value"], F.lit("")), x))
        good = F.filter(values, lambda v: v.isNotNull())
        # A value that can't be read doesn't hide a later one that can
        return good if f.multi else F.get(good, F.lit(0))

    def unread(f: Field) -> Column:
        bad = F.filter(own(f), lambda x: typed(f, x["value"], x).isNull() & (x["value"] != ""))
        return F.transform(bad, lambda x: F.struct(F.lit(f.name).alias("name"), x["value"].alias("value")))

    columns = [read_as(f).alias(f.name) for f in catalog.fields.values()]
    bad = [unread(f) for f in catalog.fields.values() if f.is_number or f.type == "date"]
    rest = [F.col(f"`{c}`") for c in raw.columns if c != fields and c not in catalog.fields]
    none = F.array().cast("array<struct<name:string,value:string>>")
    warned = raw.select(F.explode(F.concat(none, *bad)).alias("w")).select("w.*")
    return raw.select(*rest, *columns), warned


def with_system_fields(df: DataFrame, source: Column, path: Column, modified: Column, creator: str = "sievelight") -> DataFrame:
    """df with _src, _path, _lastmodified and _creator, replacing any of these names."""
    return df.withColumns({"_src": source, "_path": path, "_lastmodified": modified, "_creator": F.lit(creator)})


def drop_fields(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def fold_catalog(definitions: DataFrame, name: str = "catalog") -> Catalog:
    """A catalog from (ordinal, name, type, tokenize, doc_values, date_format, resolution, multi): the first definition of each name holds.

    Only distinct definitions reach the driver, each with its first ordinal.
    """
    first = definitions.groupBy("name", "type", "tokenize", "doc_values", "date_format", "resolution").agg(F.min("ordinal").alias("ordinal"), F.max("multi").alias("multi")).orderBy("ordinal", "name")
    out, multi = Catalog(name), {}
    rows = first.collect()
    for r in rows:
        multi[r.name] = multi.get(r.name, False) or bool(r.multi)
    for r in rows:
        kind = r.type if r.type in NUMERIC else "date" if r.date_format else "text" if r.tokenize else "keyword"
        out.register(Field(r.name, kind, resolution=Resolution.of(r.resolution or ("DAY" if r.date_format else None)), doc_values=r.doc_values or "none", date_format=r.date_format, multi=multi[r.name]))
    return out


def is_struct_of_fields(schema: T.StructType) -> bool:
    return "fields" in schema.names
