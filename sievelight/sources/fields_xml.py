"""Documents as XML field records: <document><field name="..">value</field></document>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attributes of a field in the current version and in the older one.
ATTRIBUTES = ("name", "store", "index", "tokenize", "doc-values", "numeric-type", "date-format", "date-resolution", "precision-step", "compressed", "compress", "boost", "type", "resolution")
VERSIONS = ("2.0", "5.0")
#: Of the older version: whether an index mode tokenizes, and whether it indexes.
OLD_INDEX = {"analyzed": (True, True), "tokenised": (True, True), "analyzed-no-norms": (True, True), "not-analyzed": (False, True), "not-analyzed-no-norms": (False, True), "un-tokenised": (False, True), "no": (False, False)}
SCHEMA = T.StructType([T.StructField("field", T.ArrayType(T.StructType([T.StructField(f"_{a}", T.StringType()) for a in ATTRIBUTES] + [T.StructField("_VALUE", T.StringType())])))])


#: The values that an attribute may have, of the current version.
ALLOWED = {
    "store": ("false", "true", "compress"),
    "index": ("docs", "docs-and-freqs", "docs-and-freqs-and-positions", "docs-and-freqs-and-positions-and-offsets", "none"),
    "tokenize": ("false", "true"),
    "doc-values": ("none", "sorted", "sorted-set"),
    "numeric-type": ("double", "float", "int", "long"),
    "date-resolution": ("year", "month", "day", "hour", "minute", "second", "milli"),
}
_EXTRA = ("term-vector", "term-vector-positions", "term-vector-offsets", "term-vector-payloads")


def tags(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, tag): all start tags of documents, document and field in the files, a tag to a row whatever the lines."""
    raw = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?s)<((?:documents|document|field)(?:\s.*|/?))$", 1).alias("tag"))
    return raw.where("tag <> ''")


def _attribute(tag, name: str):
    found = F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*(?:"([^"]*)"|'[^']*')""", 1)
    other = F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*'([^']*)'""", 1)
    return F.nullif(F.concat(found, other), F.lit(""))


def versions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, version, timezone) from the outermost element of each file."""
    heads = tags(spark, path).where(F.col("tag").rlike(r"^documents(\s|/|$)"))
    return heads.groupBy("file").agg(F.max(_attribute(F.col("tag"), "version")).alias("version"), F.max(_attribute(F.col("tag"), "timezone")).alias("timezone"))


#: Files whose heads are sent to all tasks, at most; of more, documents are joined to them through an exchange.
FILES = 100_000


def _sent(heads: DataFrame, files: int) -> DataFrame:
    """Heads for a join by file, without moving the documents of a file to one task."""
    return F.broadcast(heads) if files <= FILES else heads


def validate(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, problem): what the grammar of the current version doesn't allow, once for each file; no rows for valid files.

    Of files of the older version only the version itself is looked at.
    """
    heads = versions(spark, path)
    found = tags(spark, path).join(_sent(heads.where(F.col("version") == VERSIONS[1]).select("file"), heads.count()), "file", "left_semi")
    tag = F.col("tag")
    kind = F.regexp_extract(tag, r"^([a-z]+)", 1)
    names = F.regexp_extract_all(F.regexp_replace(tag, r"""(?s)"[^"]*"|'[^']*'""", "''"), F.lit(r"([\w:-]+)\s*="), F.lit(1))
    known = F.when(kind == "documents", F.array(F.lit("version"), F.lit("timezone"))).when(kind == "document", F.array(F.lit("boost"))).otherwise(F.array(*[F.lit(a) for a in (*ATTRIBUTES[:-2], *_EXTRA) if a not in ("compressed", "compress")]))
    problems = [F.when((kind == "field") & _attribute(tag, "name").isNull(), F.lit("a field without a name"))]
    for a, values in ALLOWED.items():
        value = _attribute(tag, a)
        problems.append(F.when((kind == "field") & ~value.isin(*values), F.concat(F.lit(f"{a} can't be "), value)))
    each = F.filter(F.concat(F.array(*problems), F.transform(F.array_except(names, known), lambda a: F.concat(F.lit("no attribute "), a))), lambda p: p.isNotNull())
    inside = found.select("file", F.explode(each).alias("problem"))
    # Files whose outermost element is another have no version; they are told by the reader's own listing
    every = (spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))).select(_plain("file").alias("file"))
    both = every.join(heads.select(_plain("file").alias("file"), "version"), "file", "left")
    outside = both.where(F.col("version").isNull() | ~F.col("version").isin(*VERSIONS)).select("file", F.coalesce(F.concat(F.lit("version "), "version", F.lit(f" isn't one of {', '.join(VERSIONS)}")), F.lit("no documents of a version")).alias("problem"))
    return inside.select(_plain("file").alias("file"), "problem").union(outside).distinct()


def _plain(name: str):
    """A path with one slash after its scheme, however it was listed."""
    return F.regexp_replace(name, "^file:/+", "file:/")


class UnknownVersion(ValueError):
    """Records of a version that can't be read."""


def read(spark: SparkSession, path: str | list[str], version: str | None = None, timezone: str | None = None) -> DataFrame:
    """(fields, file, modified): one row for each document that has fields; empty elements keep the empty string.

    Each file's version and time zone are those of its outermost element, unless they are given; files of a
    version other than these two are an error. Old records give dates with a time in the file's time
    zone, GMT if it has none; plain dates are GMT.
    """
    if version is not None and version not in VERSIONS:
        raise UnknownVersion(f"version {version} isn't one of {', '.join(VERSIONS)}")
    raw = spark.read.format("xml").option("rowTag", "document").option("ignoreSurroundingSpaces", "false").schema(SCHEMA).load(path)
    raw = raw.select("field", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    heads = versions(spark, path)
    unknown = F.col("version").isNull() | ~F.col("version").isin(*VERSIONS)
    all_heads = heads.agg(F.count("*").alias("files"), F.min(F.when(unknown, F.struct("file", "version"))).alias("bad")).first()
    if version is None and all_heads.bad is not None:
        raise UnknownVersion(f"{all_heads.bad.file}: version {all_heads.bad.version} isn't one of {', '.join(VERSIONS)}")
    given = heads.select(F.col("file").alias("__file"), F.col("version").alias("__version"), F.col("timezone").alias("__zone"))
    raw = raw.join(_sent(given, all_heads.files), F.col("file") == F.col("__file"), "left")
    is_current = F.lit(version == VERSIONS[1]) if version else F.coalesce(F.col("__version"), F.lit("")) == VERSIONS[1]
    zone = F.lit(timezone) if timezone else F.coalesce("__zone", F.lit("GMT"))
    x = lambda c, a: c[f"_{a}"]

    def current(c):
        return F.struct(
            x(c, "name").alias("name"),
            F.coalesce(c["_VALUE"], F.lit("")).alias("value"),
            F.lower(x(c, "numeric-type")).alias("type"),
            (F.coalesce(x(c, "tokenize"), F.lit("true")) != "false").alias("tokenize"),
            (F.coalesce(x(c, "index"), F.lit("docs")) != "none").alias("indexed"),
            (F.coalesce(x(c, "store"), F.lit("true")) != "false").alias("stored"),
            F.coalesce(F.lower(x(c, "doc-values")), F.lit("none")).alias("doc_values"),
            x(c, "date-format").alias("date_format"),
            F.upper(x(c, "date-resolution")).alias("resolution"),
            F.lit("GMT").alias("timezone"),
        )

    def old(c):
        mode = F.lower(F.coalesce(x(c, "index"), F.lit("analyzed")))
        timed = x(c, "date-format").rlike("[HhKkm]")
        return F.struct(
            x(c, "name").alias("name"),
            F.coalesce(c["_VALUE"], F.lit("")).alias("value"),
            F.lower(F.coalesce(x(c, "numeric-type"), x(c, "type"))).alias("type"),
            mode.isin(*[k for k, v in OLD_INDEX.items() if v[0]]).alias("tokenize"),
            (mode != "no").alias("indexed"),
            (F.coalesce(x(c, "store"), F.lit("yes")).isin("yes", "true", "compress")).alias("stored"),
            F.lit("none").alias("doc_values"),
            x(c, "date-format").alias("date_format"),
            F.upper(F.coalesce(x(c, "date-resolution"), x(c, "resolution"))).alias("resolution"),
            F.when(timed, zone).otherwise("GMT").alias("timezone"),
        )

    fields = F.when(is_current, F.transform("field", current)).otherwise(F.transform("field", old))
    return raw.select(fields.alias("fields"), "file", "modified").where("size(fields) > 0")


def definitions(docs: DataFrame, ordinal: str) -> DataFrame:
    """The definitions of indexed fields, for operators.store.fold_catalog."""
    each = docs.select(F.col(ordinal).alias("ordinal"), F.explode("fields").alias("f"), "fields")
    multi = F.size(F.filter("fields", lambda x: x["name"] == F.col("f.name"))) > 1
    return each.where("f.indexed").select("ordinal", "f.name", F.col("f.type").alias("type"), "f.tokenize", "f.doc_values", "f.date_format", "f.resolution", multi.alias("multi"))


def to_xml(df: DataFrame, element: str = "document") -> DataFrame:
    """(xml): each row as an element of fields, `<document><field name="..">value</field>..</document>`, several values as several fields, nulls left out."""
    def field(name: str, value):
        text = value.cast("string")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(entity))
        return F.concat(F.lit(f'<field name="{name}">'), text, F.lit("</field>"))

    def of(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: field(f.name, x)), ""), F.lit(""))
        return F.coalesce(field(f.name, c), F.lit(""))

    return df.select(F.concat(F.lit(f"<{element}>"), *[of(f) for f in df.schema], F.lit(f"</{element}>")).alias("xml"))


#: Characters of records in a file that write_records makes, so that neither its writer nor a task that reads it, which takes files whole, follows the size of a partition.
FILE = 16 << 20


def write_records(df: DataFrame, path: str, definitions: dict[str, str] | None = None, version: str = "5.0", timezone: str | None = None, most: int = FILE) -> None:
    """Rows as files of field records that `read` takes, each of about `most` characters or one record; definitions: further attributes of a field, as XML."""
    more = definitions or {}
    rows = to_xml(df)
    for name, attributes in more.items():
        rows = rows.select(F.replace("xml", F.lit(f'<field name="{name}">'), F.lit(f'<field name="{name}" {attributes}>')).alias("xml"))
    zone = f' timezone="{timezone}"' if timezone else ""

    def whole(batches):
        import pandas as pd

        def file(parts):
            return pd.DataFrame({"value": [f'<documents version="{version}"{zone}>' + "\n".join(parts) + "</documents>"]})

        parts, size, made = [], 0, False
        for b in batches:
            for x in b["xml"]:
                if parts and size + len(x) > most:
                    yield file(parts)
                    parts, size, made = [], 0, True
                parts.append(x)
                size += len(x)
        if parts or not made:
            yield file(parts)

    # A row is a file
    rows.mapInPandas(whole, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write(df: DataFrame, path: str) -> None:
    """Rows as XML, one element each."""
    df.write.format("xml").option("rootTag", "documents").option("rowTag", "document").mode("overwrite").save(path)
