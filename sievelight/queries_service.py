"""Registered queries of storage, sources, streams, the service and the smaller functions, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis as an
from .functions import dates as D
from .functions.highlight import first_extract, highlight
from .operators import facets as fc
from .operators import search as se
from .operators import store as st
from .operators import suggest as su
from .operators import terms as te
from .operators.index import Index, union
from .plans import language as la
from .plans import nodes as Q
from .queries import P0, T0, customers, events, orders, parts, plain_documents, read
from .schema import Catalog, Field
from .service import Engine
from .sources import fields_xml as xml
from .sources import folders as fo
from .sources.routes import is_valid_name_column
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    return f"{st.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ records and folders

_PART_XML = {"p_partkey": 'tokenize="false" numeric-type="long"', "p_brand": 'tokenize="false" doc-values="sorted"', "p_size": 'numeric-type="int"', "p_retailprice": 'numeric-type="double"'}
_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def part_records(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "records")
    xml.write_records(read(spark, sf_dir, "part").select(*_PART_COLUMNS), path, _PART_XML)
    return path


@add(f"SELECT {', '.join(_PART_COLUMNS)} FROM part")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of field records, indexed as a folder, and read again from the index."""
    engine = Engine.local(spark, folder(spark, "engine"))
    engine.index_folder("parts", part_records(spark, sf_dir), regex=r"part-[^/]*\.txt$")
    return engine.open("parts").df.select(*_PART_COLUMNS)


@add("SELECT p_partkey FROM part WHERE list_contains(" + P0 + ", 'widget') AND p_size BETWEEN 5 AND 20")
def ingest_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of an index that was made from records, by its stored postings."""
    engine = Engine.local(spark, folder(spark, "engine"))
    engine.index_folder("parts", part_records(spark, sf_dir), regex=r"part-[^/]*\.txt$")
    index = engine.open("parts")
    return se.matches(index, Q.Term("p_name", "widget") & Q.NumberRange("p_size", "int", 5, 20)).select("p_partkey")


@add("SELECT o_orderkey, o_orderdate - INTERVAL 10 HOUR AS at, CAST(o_orderdate AS DATE)::TIMESTAMP AS day FROM orders")
def old_records_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the older version: dates with a time are read in the zone of their file, plain dates aren't."""
    path = folder(spark, "old")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    xml.write_records(rows, path, {"o_orderkey": 'index="not-analyzed" type="long"', "at": 'index="not-analyzed" date-format="yyyy-MM-dd HH:mm" date-resolution="minute"', "day": 'index="not-analyzed" date-format="yyyy-MM-dd" date-resolution="day"'}, "2.0", "+10:00")
    raw = xml.read(spark, path)
    catalog = st.fold_catalog(xml.definitions(raw.withColumn("n", F.monotonically_increasing_id()), "n"))
    typed, _ = st.convert(raw, catalog)
    return typed.select("o_orderkey", "at", "day")


@add("SELECT 'store can''t be maybe' AS problem UNION SELECT 'numeric-type can''t be decimal' UNION SELECT 'no attribute colour' UNION SELECT 'a field without a name' UNION SELECT 'version 3.0 isn''t one of 2.0, 5.0'")
def records_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "invalid")
    bad = '<documents version="5.0"><document><field name="a" store="maybe">x</field><field name="b" numeric-type="decimal" colour="red">1</field><field>y</field></document></documents>'
    rows = read(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, bad).when(F.col("r_regionkey") == 1, '<documents version="3.0"/>').otherwise(F.concat(F.lit('<documents version="5.0"><document><field name="n">'), "r_name", F.lit("</field></document></documents>"))).alias("value"))
    rows.repartition(5, "value").write.text(path)
    return xml.validate(spark, path).select("problem").distinct()


@add("SELECT '<part><field name=\"p_partkey\">' || p_partkey || '</field><field name=\"p_name\">' || p_name || '</field></part>' AS xml FROM part")
def xml_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.to_xml(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "part")


@add("SELECT CASE k WHEN 0 THEN 'p_partkey' WHEN 1 THEN 'p_name' ELSE 'p_brand' END AS name, CASE k WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_name ELSE p_brand END AS value FROM part, range(3) t(k)")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a folder would give, without storing them."""
    path = folder(spark, "records")
    xml.write_records(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path, _PART_XML)
    return Engine(spark).dry_run(path).select(F.explode("fields").alias("f")).select("f.name", "f.value")


@add("SELECT r_name AS text, 'text/plain' AS media FROM region")
def files_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files listed with their contents, and translated by media type."""
    path = folder(spark, "files")
    read(spark, sf_dir, "region").select("r_name").repartition(5, "r_name").write.option("lineSep", "\n").text(path)
    listed = fo.listing(spark, path, r"part-[^/]*\.txt$", content=True).where("length > 0")
    return fo.Translators().translate(listed).select(F.explode(F.split("text", "\n")).alias("text"), "media").where("text <> ''")


@add("SELECT url AS path, page_id AS modified FROM pages WHERE starts_with(url, 'https://') AND regexp_matches(url, 'en')")
def existing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index.of(read(spark, sf_dir, "pages"), "page_id", Field("url", "keyword"))
    return fo.existing(index, "https://", "en", "url", "page_id")


@add("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 7) END AS path, length(url) <= 255 AND regexp_full_match(url, '[\\w\\-@$.]+') AS valid FROM pages")
def paths_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root, and whether a text can name an index."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", fo.relative_column("https:/", F.col("url")).alias("path"), is_valid_name_column(F.col("url")).alias("valid"))


# ------------------------------------------------------------------ storage

_EVENT_FIELDS = {"event_type": Field("event_type", "keyword"), "value": Field("value", "double"), "user_id": Field("user_id", "long")}


def event_store(spark: SparkSession, sf_dir: str, condition: str = "true") -> st.IndexStore:
    store = st.IndexStore(spark, folder(spark, "store"), _EVENT_FIELDS)
    store.publish(read(spark, sf_dir, "events").where(condition).select("event_id", "user_id", "event_type", "value"))
    return store


_NEW = "SELECT max_by(event_id, event_id) AS event_id, user_id, event_type, max_by(value, event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id, event_type"


@add(f"WITH b AS ({_NEW}) SELECT event_id, user_id, event_type, value FROM events a WHERE ts < TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id) UNION ALL SELECT * FROM b")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows in a segment of their own take the place of all old ones with the same key."""
    store = event_store(spark, sf_dir, "ts < timestamp '2024-01-15'")
    late = read(spark, sf_dir, "events").where("ts >= timestamp '2024-01-15'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    store.upsert(late.select("event_id", "user_id", "event_type", "value"), "user_id")
    return store.read()


@add("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'error' AND NOT coalesce(value > 90, false)")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the documents of a term, and of a condition."""
    store = event_store(spark, sf_dir)
    store.delete_matching(Q.Term("event_type", "error"))
    store.delete(F.col("value") > 90)
    return store.read().select("event_id")


@add("SELECT event_id FROM events ORDER BY CASE WHEN event_type = 'error' THEN -1 ELSE value END, event_id LIMIT 20")
def store_update_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value set for sorting moves documents."""
    store = event_store(spark, sf_dir)
    store.update(F.col("event_type") == "error", "value", F.lit(-1.0))
    index = store.index()
    return index.df.orderBy(*se.sort_columns(index, ["value"])[:1], "event_id").limit(20).select("event_id")


@add("SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value = -1")
def store_update_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """It isn't found by a search for that value."""
    store = event_store(spark, sf_dir)
    store.update(F.col("event_type") == "error", "value", F.lit(-1.0))
    return se.count(store.index(), Q.Number("value", -1.0, "double")).withColumnRenamed("count", "n")


@add("SELECT 1 AS version, count(*) AS n FROM events UNION ALL SELECT 2, count(*) FROM events WHERE event_type IS DISTINCT FROM 'view' UNION ALL SELECT 3, 0 UNION ALL SELECT 4, count(*) FROM events WHERE event_type = 'view'")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version shows: written, deleted from, cleared, appended to."""
    store = event_store(spark, sf_dir)
    store.delete(F.col("event_type") == "view")
    store.clear()
    store.append(read(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "user_id", "event_type", "value"))
    each = [store.read(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n") for v in range(1, 5)]
    return reduce(lambda a, b: a.union(b), each)


@add("SELECT event_id, value FROM events WHERE event_type IS DISTINCT FROM 'view'")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = event_store(spark, sf_dir)
    store.delete(F.col("event_type") == "view")
    store.compact()
    return store.read().select("event_id", "value")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents WHERE lang <> 'en') GROUP BY 1")
def postings_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of a stored index from which documents were deleted."""
    index = plain_documents(spark, sf_dir)
    store = st.IndexStore(spark, folder(spark, "store"), index.fields)
    store.publish(index.df)
    store.delete_matching(Q.Term("lang", "en"))
    return te.dictionary(store.index(), "text").select("term", F.col("count").alias("n"))


@add("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, event_id % 7 AS b FROM events")
def converted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that can't be read leave their field out; a later one that can be counts."""
    rows = read(spark, sf_dir, "events")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    raw = rows.select("event_id", F.array(pair("a", F.when(F.col("event_id") % 3 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))), pair("b", F.lit("x")), pair("b", (F.col("event_id") % 7).cast("string"))).alias("fields"))
    catalog = Catalog()
    for f in (Field("a", "double"), Field("b", "long")):
        catalog.register(f)
    return st.convert(raw, catalog)[0].select("event_id", "a", "b")


@add("SELECT event_id, 'events' AS _creator, 'x' AS _src FROM events")
def system_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", F.lit("old").alias("_src"))
    return st.with_system_fields(df, F.lit("x"), F.lit("/"), F.current_timestamp(), "events").select("event_id", "_creator", "_src")


@add("SELECT p_partkey, p_name FROM part")
def fields_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by the beginning of their names, without one of them."""
    index = Index.of(read(spark, sf_dir, "part"), "p_partkey", *[Field(n, "keyword") for n in ("p_name", "p_brand", "p_type")])
    catalog = Catalog(fields=index.fields)
    return st.drop_fields(st.drop_fields(index.df.select("p_partkey", *catalog.by_prefix("p_")), "p_brand"), "p_type")


# ------------------------------------------------------------------ queries


@add("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199703' AND o_orderstatus = 'F'")
def facet_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two facets as parameters of a search; one without a value is left out."""
    index = orders(spark, sf_dir)
    chosen = [fc.FacetValue(fc.DateFacet("month", resolution=D.Resolution.MONTH), "199703"), fc.FacetValue(fc.FieldFacet("status"), "F"), fc.FacetValue(fc.FieldFacet("priority"), None)]
    return se.matches(index, Q.all_of(*[v.to_query() for v in chosen if not v.is_empty()])).select("o_orderkey")


@add(f"SELECT p_partkey FROM (SELECT p_partkey, {P0} AS t FROM part) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'cold' AND t[i + 1] = 'widget')) > 0 OR len(list_filter(t, lambda x: regexp_full_match(x, 'r.d.*'))) > 0")
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted text is a phrase, text with wildcards a pattern."""
    return se.matches(parts(spark, sf_dir), la.term_or_phrase("name", '"cold widget"') | la.term_or_phrase("name", "r?d*")).select("p_partkey")


@add(f"SELECT p_partkey FROM (SELECT p_partkey, {P0} AS t FROM part) WHERE list_contains(t, 'cold') OR list_contains(t, 'widget') OR len(list_filter(t, lambda x: starts_with(x, 'gi'))) > 0")
def dispatched_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under an analyzer words are cut and put in lower case."""
    found = [*la.analysed("name", "COLD Widget", True, an.STANDARD), *la.analysed("name", "GI*", True, an.STANDARD)]
    return se.matches(parts(spark, sf_dir), Q.any_of(*found)).select("p_partkey")


@add(f"SELECT p_partkey FROM part WHERE (list_contains({P0}, 'widget') AND NOT list_contains({P0}, 'cold')) OR (p_type = 'widget' AND NOT p_type = 'cold')")
def predicate_over_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.matches(parts(spark, sf_dir), la.predicate_over(["name", "type"], "+widget -cold")).select("p_partkey")


@add(f"SELECT doc_id FROM (SELECT doc_id, {T0} AS t FROM documents) WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' AND len(list_filter(range(1, 4), lambda d: t[i + d] = 'of')) > 0)) > 0 OR len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0")
def phrase_with_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms at most two places out of their order, which includes the reverse."""
    from .queries import documents

    return se.matches(documents(spark, sf_dir), la.parse_predicate('text:"the of"~2')).select("doc_id")


_SPAN = "len(list_filter(range(-1, len(t) + 1), lambda m: len(list_filter(range(0, 2), lambda d: t[m + d] = 'the')) > 0 AND len(list_filter(range(0, 2), lambda d: t[m + 1 + d] = 'of')) > 0 AND len(list_filter(range(0, 2), lambda d: t[m + 2 + d] = 'and')) > 0)) > 0"


@add(f"SELECT doc_id FROM (SELECT doc_id, {T0} AS t FROM documents) WHERE {_SPAN}")
def phrase_with_one_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place of slop for three terms together."""
    return se.matches(plain_documents(spark, sf_dir), Q.Phrase("text", ("the", "of", "and"), 1)).select("doc_id")


@dataclass(frozen=True)
class Divisible(Q.Query):
    """A query node of a user's own."""

    column: str
    by: int

    def to_column(self, index: Index) -> Column:
        return F.col(self.column) % self.by == 0


@add(f"SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 AND list_contains({P0}, 'widget')")
def query_of_a_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.matches(parts(spark, sf_dir), Divisible("p_partkey", 7) & Q.Term("name", "widget")).select("p_partkey")


@add(f"SELECT term FROM (SELECT DISTINCT unnest({P0}) AS term FROM part) WHERE levenshtein(term, 'gold') BETWEEN 1 AND 2")
def similar_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings that take the place of a term in similar queries."""
    found = su.similar_queries(parts(spark, sf_dir), Q.Bool(((Q.MUST, Q.Boost(Q.Term("name", "gold"), 2.0)), (Q.MUST_NOT, Q.Term("type", "x")))))
    return spark.createDataFrame([(q.clauses[0][1].query.text,) for q in found], "term string")


@add(f"SELECT text FROM (SELECT replace('gold bolts', 'gold', term) AS text FROM (SELECT DISTINCT unnest({P0}) AS term FROM part) WHERE levenshtein(term, 'gold') BETWEEN 1 AND 2 UNION SELECT replace('gold bolts', 'bolts', term) FROM (SELECT DISTINCT unnest({P0}) AS term FROM part) WHERE levenshtein(term, 'bolts') BETWEEN 1 AND 2)")
def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one word replaced by a near spelling."""
    found = su.similar_questions(parts(spark, sf_dir), la.Question({"name": 1.0}, "gold bolts"), 1000)
    return spark.createDataFrame([(q.text,) for q in found], "text string").distinct()


@add("SELECT p_partkey, 2.0 * (p_size BETWEEN 5 AND 9)::INT + (starts_with(p_brand, 'Brand#1'))::INT::DOUBLE AS score FROM part WHERE p_size BETWEEN 5 AND 9 OR starts_with(p_brand, 'Brand#1')")
def constant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and prefixes score 1 where they match, times their boost."""
    query = Q.Boost(Q.NumberRange("size", "int", 5, 9), 2.0) | Q.Prefix("brand", "Brand#1")
    return se.bm25(parts(spark, sf_dir), query).select("p_partkey", "score")


_PHRASE = (
    "WITH d AS (SELECT doc_id, {t} AS t FROM documents), s AS (SELECT avg(len(t)) FILTER (len(t) > 0) AS a, CAST(count(*) FILTER (len(t) > 0) AS DOUBLE) AS n, "
    "CAST(count(*) FILTER (list_contains(t, 'of')) AS DOUBLE) AS f1, CAST(count(*) FILTER (list_contains(t, 'the')) AS DOUBLE) AS f2 FROM d), "
    "x AS (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS c, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / a) AS k, n, f1, f2 FROM d, s) "
    "SELECT doc_id, round((ln(1 + (n - f1 + 0.5::DOUBLE) / (f1 + 0.5::DOUBLE)) + ln(1 + (n - f2 + 0.5::DOUBLE) / (f2 + 0.5::DOUBLE))) * c / (c + k), 4) AS score FROM x WHERE c > 0"
).format(t=T0)


@add(_PHRASE)
def phrase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase scores by how often it occurs itself."""
    from .queries import documents

    return se.bm25(documents(spark, sf_dir), Q.Phrase("text", ("of", "the"))).select("doc_id", F.round("score", 4).alias("score"))


@add(_PHRASE)
def phrase_score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a stored index."""
    return se.bm25(plain_documents(spark, sf_dir), Q.Phrase("text", ("of", "the"))).select("doc_id", F.round("score", 4).alias("score"))


@add("SELECT o_orderpriority AS term, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT strftime(o_orderdate, '%Y%m'), count(*) FROM orders GROUP BY 1")
def facet_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets that fit the type of a field; a number has none."""
    index = orders(spark, sf_dir)
    assert fc.create(index, "total") is None
    return fc.create(index, "priority").counts(index).union(fc.create(index, "month").counts(index)).withColumnRenamed("count", "n")


@add("SELECT CASE WHEN c_acctbal < 0 THEN 'below' ELSE 'above' END AS side, count(*) AS n FROM customer GROUP BY 1")
def facet_range_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = customers(spark, sf_dir)
    found = fc.create_range(index, "balance", [fc.Range(None, 0.0, True, False), fc.Range(0.0, None)]).counts(index)
    return found.select(F.when(F.col("min").isNull(), "below").otherwise("above").alias("side"), F.col("count").alias("n"))


@add("SELECT strftime(lo, '%Y%m%d') AS min, count(*) AS n FROM (SELECT TIMESTAMP '1900-01-01' + INTERVAL 1 DAY * (date_diff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) // 7 * 7) AS lo FROM orders) GROUP BY 1")
def facet_weeks_from_1900(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of time by arithmetic, however far from their start."""
    from datetime import timedelta

    return fc.DateIntervalFacet("day", datetime(1900, 1, 1), time=timedelta(days=7)).counts(orders(spark, sf_dir)).select("min", F.col("count").alias("n"))


# ------------------------------------------------------------------ functions


@add("SELECT p_partkey, coalesce(CASE WHEN regexp_matches(p_type, '(?i)\\bwidget\\b') THEN '<term>' || p_type || '</term>' END, regexp_replace(p_name, '(?i)\\b(widget)\\b', '<term>\\1</term>')) AS extract FROM part WHERE regexp_matches(p_name, '(?i)\\bwidget\\b') OR regexp_matches(p_type, '(?i)\\bwidget\\b')")
def extract_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract of the first field that has the term."""
    return read(spark, sf_dir, "part").select("p_partkey", first_extract([F.col("p_type"), F.col("p_name")], "widget").alias("extract")).where("extract is not null")


@add(
    "WITH a AS (SELECT doc_id, text AS t, length(regexp_extract(text, '(?is)^(?:.*?[^0-9A-Za-z_])??(the)(?:[^0-9A-Za-z_]|$)')) AS whole, regexp_extract(text, '(?is)^((?:.*?[^0-9A-Za-z_])??)the(?:[^0-9A-Za-z_]|$)', 1) AS lead FROM documents WHERE text NOT LIKE '%&%' AND text NOT LIKE '%<%' AND text NOT LIKE '%>%' AND text NOT LIKE '%\"%'), "
    "b AS (SELECT doc_id, t, length(lead) AS s, length(lead) + 3 AS e, length(t) AS n FROM a WHERE whole > 0) "
    "SELECT doc_id, CASE WHEN n < 60 THEN substr(t, 1, s) || '<term>' || substr(t, s + 1, 3) || '</term>' || substr(t, e + 1) "
    "WHEN s < 28 THEN substr(t, 1, s) || '<term>' || substr(t, s + 1, 3) || '</term>' || CASE WHEN n - e < 57 - s THEN substr(t, e + 1) ELSE substr(t, e + 1, 56 - s) || '...' END "
    "WHEN n - e < 28 THEN CASE WHEN n - e > s THEN substr(t, 1, s) ELSE '...' || substr(t, s - (n - e) + 1, n - e) END || '<term>' || substr(t, s + 1, 3) || '</term>' || substr(t, e + 1) "
    "ELSE '...' || substr(t, s - 28 + 1, 28) || '<term>' || substr(t, s + 1, 3) || '</term>' || substr(t, e + 1, 28) || '...' END AS extract FROM b"
)
def extract_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of documents, cut where they are longer; texts with signs that are escaped are left to the tests."""
    from .functions.highlight import extract

    docs = read(spark, sf_dir, "documents").where(~F.col("text").rlike('[&<>"]'))
    return docs.select("doc_id", extract(F.col("text"), "the", 60).alias("extract")).where("extract is not null")


@add("SELECT p_partkey, regexp_replace(p_name, '\\b(widget|cold)\\b', '<term>\\1</term>', 'g') AS fragment FROM part WHERE regexp_matches(p_name, '\\b(widget|cold)\\b')")
def highlighted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a short text, its terms marked."""
    return read(spark, sf_dir, "part").select("p_partkey", highlight(F.col("p_name"), {"widget": 1.0, "cold": 1.0}, 200).alias("fragment")).where("fragment is not null")


@add(f"SELECT p_partkey, {P0} AS terms FROM part")
def analysed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", an.STANDARD.tokens(F.col("p_name")).alias("terms"))


@add("SELECT * FROM (VALUES ('one'), ('\"two three\"'), ('four')) t(value)")
def values_of_a_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in an.split_values('one "two three" four')], "value string")


@add("SELECT * FROM (VALUES ('\"a b\"', true, false, true), ('a*', false, true, true), ('a OR b', false, false, false)) t(text, phrase, wild, plain)")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, an.is_phrase(t), an.has_wildcards(t), an.has_no_operators(t)) for t in ('"a b"', "a*", "a OR b")], "text string, phrase boolean, wild boolean, plain boolean")


@add("SELECT * FROM (VALUES ('a', 1.0::DOUBLE), ('b', 1.0::DOUBLE)) t(name, boost)")
def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(an.as_boost_map(["a", "", "b"]).items()), "name string, boost double")


@add("SELECT event_id, date_trunc('day', ts) AS low, date_trunc('day', ts) + INTERVAL 1 DAY AS high, true AS with_low FROM events")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates as a struct."""
    day = F.date_trunc("day", "ts")
    return read(spark, sf_dir, "events").select("event_id", D.range_struct(day, day + F.expr("interval 1 day"), True, False).alias("r")).select("event_id", F.col("r.from").alias("low"), F.col("r.to").alias("high"), F.col("r.include_from").alias("with_low"))


@add("SELECT * FROM (VALUES ('docs', 'int', 'sorted-numeric', 'DAY', 'yyyy-MM-dd'), ('docs-and-freqs-and-positions-and-offsets', NULL, 'none', 'HOUR', NULL)) t(a, b, c, d, e)")
def names_of_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import parse_date_format, parse_doc_values, parse_index, parse_numeric

    rows = [(parse_index(a), parse_numeric(b), parse_doc_values(c, True), D.Resolution.of(d).name, parse_date_format(e)) for a, b, c, d, e in (("DOCS", "INT", "sorted", "odd", "yyyy-MM-dd"), (None, "decimal", "x", "hour", "yyyy-bb'"))]
    return spark.createDataFrame(rows, "a string, b string, c string, d string, e string")


@add("SELECT * FROM (VALUES ('name', 'x'), ('name', 'y'), ('brand', 'x'), ('brand', 'y')) t(field, term)")
def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(te.pairs(["name", "brand"], ["x", "y"]), "field string, term string")


@add("SELECT * FROM (VALUES ('brand'), ('name'), ('name_exact'), ('type')) t(field)")
def term_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in te.fields(parts(spark, sf_dir))], "field string")


@add(f"SELECT count(*) AS n FROM documents WHERE len({T0}) > 0")
def term_doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents

    return te.doc_count(documents(spark, sf_dir), "text").withColumnRenamed("count", "n")


_LIKE = (
    "WITH d AS (SELECT doc_id, {t} AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1), "
    "s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (len(t) > 0)::DOUBLE AS m, avg(len(t)) FILTER (len(t) > 0) AS a FROM d), "
    "q AS (SELECT p.term, f.df FROM p JOIN f USING (term), s WHERE doc_id = (SELECT min(doc_id) FROM d) ORDER BY p.tf * (ln((n + 1) / (df + 1)) + 1) DESC, p.term LIMIT 25) "
    "SELECT p.doc_id, round(sum(ln(1 + (m - q.df + 0.5::DOUBLE) / (q.df + 0.5::DOUBLE)) * p.tf / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.t) / a))), 3) AS score FROM p JOIN q USING (term) JOIN d ON d.doc_id = p.doc_id, s WHERE p.doc_id <> (SELECT min(doc_id) FROM d) GROUP BY 1 ORDER BY score DESC, p.doc_id LIMIT 20"
).format(t=T0)


@add(_LIKE)
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like the first one, by its weightiest terms."""
    from .queries import documents

    index = documents(spark, sf_dir)
    first = index.df.agg(F.min("doc_id")).first()[0]
    return su.similar_documents(index, first, ["text"]).select("doc_id", F.round("score", 3).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


# ------------------------------------------------------------------ streams


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("ts is not null")
    return rows.select("event_id", "ts", F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string")).alias("index"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("requester"), F.when(F.col("value") > 50, jobs.HIGH).otherwise(jobs.LOW).alias("priority"), F.when(F.col("event_id") % 500 == 499, F.lit("clear")).otherwise("put").alias("kind"))


_JOBS = "SELECT event_id, ts, 'i' || user_id % 5 AS idx, 'r' || user_id % 3 AS requester, CASE WHEN value > 50 THEN 0 ELSE 1 END AS p, event_id % 500 = 499 AS is_clear FROM events WHERE ts IS NOT NULL"


@add(f"SELECT event_id FROM ({_JOBS}) ORDER BY p, ts, event_id LIMIT 30")
def jobs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.in_order(_jobs(spark, sf_dir), "priority", "ts", "event_id").select("event_id").limit(30)


@add(f"SELECT event_id FROM ({_JOBS}) WHERE idx = 'i2' AND requester = 'r1'")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).jobs_in_queue(_jobs(spark, sf_dir), "i2", "r1").select("event_id")


@add(f"WITH j AS ({_JOBS}) SELECT event_id FROM j LEFT JOIN (SELECT idx, max(ts) AS c FROM j WHERE is_clear GROUP BY 1) USING (idx) WHERE c IS NULL OR ts >= c")
def jobs_after_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.after_clear(_jobs(spark, sf_dir)).select("event_id")


@add(f"SELECT idx AS index, count(*) FILTER (is_clear) AS alone, 1::BIGINT AS lanes FROM ({_JOBS}) GROUP BY 1")
def job_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that run one by one, and in how many lanes the others of an index are."""
    with_lane = jobs.lanes(_jobs(spark, sf_dir).withColumn("single", F.col("kind") == "clear"))
    return with_lane.groupBy("index").agg(F.count_if(F.col("lane") == 0).alias("alone"), F.count_distinct(F.when(F.col("lane") > 0, F.col("lane"))).alias("lanes"))


@add("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events kept as the latest of each user, batch by batch, with deletes."""
    source = folder(spark, "source")
    rows = read(spark, sf_dir, "events").where("user_id is not null").select("event_id", "user_id", "value", (F.col("event_type") == "error").alias("gone"))
    rows.where("event_id % 2 = 0").coalesce(1).write.parquet(source)
    rows.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    store = st.IndexStore(spark, folder(spark, "store"))
    stream = jobs.watch(spark, source, "event_id bigint, user_id bigint, value double, gone boolean", files_per_trigger=2)
    jobs.upsert_stream(stream, store, "user_id", ["event_id"], "gone", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination(300)
    return store.read().select("user_id", "event_id", "value")


# ------------------------------------------------------------------ the service


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    for index in (parts(spark, sf_dir), orders(spark, sf_dir), events(spark, sf_dir)):
        out.add(index)
    return out


@add(f"SELECT p_partkey FROM part WHERE list_contains({P0}, 'widget') AND p_brand = 'Brand#12' ORDER BY p_name, p_partkey LIMIT 100")
def service_basic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = engine(spark, sf_dir).basic_search("widget", "name", "brand:Brand#12", sort=["name_exact"], index="parts")
    return found.page_df.select("p_partkey")


@add(f"SELECT field, term, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS k FROM (SELECT 'brand' AS field, p_brand AS term, count(*) AS n FROM part WHERE list_contains({P0}, 'widget') GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part WHERE list_contains({P0}, 'widget') GROUP BY 2)) WHERE k <= 20")
def service_basic_search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facets = engine(spark, sf_dir).basic_search("widget", "name", facets=["brand", "type"], index="parts")
    return facets.select("field", "term", F.col("count").alias("n"))


@add("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' ORDER BY p_partkey LIMIT 100")
def service_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).term_search("brand", "Brand#12", index="parts").page_df.select("p_partkey")


@add(f"SELECT p_partkey FROM part WHERE list_contains({P0}, 'cold') AND p_brand = 'Brand#12' ORDER BY p_partkey LIMIT 100")
def service_predicate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).predicate_search("+name:cold +brand:Brand\\#12", tokenize=False, index="parts", keywords=True).page_df.select("p_partkey")


@add("SELECT 'status' AS field, o_orderstatus AS term, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 2")
def service_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).get_facets('priority:"5-LOW"', ["status"], index="orders", keywords=True).select("field", "term", F.col("count").alias("n"))


@add(f"SELECT text FROM (SELECT DISTINCT unnest({P0}) AS text FROM part) WHERE starts_with(text, 'wi') ORDER BY 1 LIMIT 10")
def service_auto_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).auto_suggest("wi", ["name"], terms=True, index="parts").select("text")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({P0})) AS term FROM part) WHERE damerau_levenshtein(term, 'gold') BETWEEN 1 AND 2 GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def service_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).lookup_fuzzy("gold", "name", index="parts").select("term", F.col("count").alias("n"))


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({P0})) AS term FROM part) WHERE starts_with(term, 'g') AND term <> 'g' GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def service_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).lookup_prefix("g", "name", index="parts").select("term", F.col("count").alias("n"))


@add(f"SELECT DISTINCT unnest({P0}) AS term FROM part")
def service_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).index_terms("name", index="parts").select("term")


@add("SELECT (SELECT count(*) FROM part) AS documents, 'brand,name,name_exact,type' AS fields")
def service_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).index_summary("parts")
    return spark.createDataFrame([(found["documents"], ",".join(found["fields"]))], "documents bigint, fields string")


@add("SELECT * FROM (VALUES ('name', 'text', true), ('name_exact', 'keyword', false), ('brand', 'keyword', false), ('type', 'keyword', false), ('size', 'int', false), ('price', 'double', false)) t(name, type, tokenized)")
def service_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f["name"], f["type"], f["tokenized"]) for f in engine(spark, sf_dir).catalog("parts")], "name string, type string, tokenized boolean")


@add("SELECT index_id, count(*) AS n FROM (SELECT 'parts' AS index_id FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 'other' FROM part WHERE p_brand = 'Brand#12') GROUP BY 1")
def service_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of two indexes at once."""
    from dataclasses import replace

    at = engine(spark, sf_dir)
    at.add(replace(parts(spark, sf_dir), name="other"))
    return se.matches(at.select("parts,other"), Q.Term("brand", "Brand#12")).groupBy("index_id").agg(F.count("*").alias("n"))


@add(f"SELECT 'documents' AS index_id, count(*) AS n FROM documents WHERE list_contains({T0}, 'the') UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE list_contains({T0}, 'the')")
def multi_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word in two indexes, each by its own postings."""
    from .queries import documents, talks

    both = union(documents(spark, sf_dir), talks(spark, sf_dir))
    return se.matches(both, Q.Term("text", "the")).groupBy("index_id").agg(F.count("*").alias("n"))


@add(f"SELECT field, term, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS k FROM (SELECT 'text' AS field, term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents WHERE lang = 'de') GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang = 'de' GROUP BY 2)) WHERE k <= 10")
def facets_of_texts_and_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of a text field, from postings, and of a keyword field under one query."""
    from .queries import documents

    return fc.many(documents(spark, sf_dir), Q.Term("lang", "de"), ["text", "source"]).select("field", "term", F.col("count").alias("n"))


@add("SELECT 3::BIGINT AS pages, count(*) AS total, false AS empty FROM part WHERE p_size <= 2")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page of results knows of all of them."""
    index = parts(spark, sf_dir)
    total = se.count(index, Q.NumberRange("size", "int", None, 2)).first()[0]
    found = se.search(index, Q.NumberRange("size", "int", None, 2), ["doc"], se.Page(1, max(1, -(-total // 3))))
    return spark.createDataFrame([(found.pages(), found.total(), found.is_empty())], "pages bigint, total bigint, empty boolean")


@add("SELECT p_partkey, (p_name IS NOT NULL)::INT::DOUBLE AS score FROM part WHERE p_name IS NOT NULL ORDER BY p_brand DESC, p_partkey LIMIT 20")
def scores_under_a_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits have their scores under any order."""
    return se.search(parts(spark, sf_dir), Q.Exists("name_exact"), ["-brand"]).page_df.select("p_partkey", "score")


@add("SELECT 'a' AS index, '/x/a' AS path, true AS watched, 'a,broken' AS names, 2::BIGINT AS seconds")
def service_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from keys; definitions that can't be are left out."""
    from .service import Config

    c = Config.from_keys({"index.types": "a,broken", "index.a.path": "/x/a", "watcher.watch": "true", "watcher.delay": "2"})
    return spark.createDataFrame([(c.routes[0].name, c.routes[0].path, c.watch, ",".join([c.routes[0].name, *c.ignored]), int(c.delay.split()[0]))], "index string, path string, watched boolean, names string, seconds bigint")
