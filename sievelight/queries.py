"""Registered queries over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates as D
from .functions.analysis import STANDARD
from .functions.highlight import extract, highlight
from .operators import facets as fc
from .operators import inverted as inv
from .operators import search as se
from .operators import store as st
from .operators import suggest as su
from .operators import terms as te
from .operators.index import Index, union
from .plans import nodes as Q
from .plans.language import Question, parse_predicate, parse_words
from .schema import Field
from .sources.folders import changes
from .sources.routes import Route, route
from .streaming import jobs

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def tok(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def add(sql: str | None = None) -> Callable[[Build], Build]:
    def keep(f: Build) -> Build:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_built: dict[tuple[str, str, str], inv.Inverted] = {}


def stored(spark: SparkSession, sf_dir: str, index: Index, build: bool = False) -> Index:
    """The index with the postings of its texts, which are written to the shared folder once for an application and table, when they are first read, or anew."""
    key = spark.sparkContext.applicationId, sf_dir, index.name
    names = [n for n, f in index.fields.items() if f.is_text]
    if build or key not in _built:
        path, buckets = f"{st.shared_folder(spark)}/index-{index.name}-{uuid.uuid4().hex}", inv.buckets_for(index.df)

        def make() -> inv.Inverted:
            inv.write(index.places(names), path, buckets)
            return inv.Inverted.read(spark, path, names, buckets)

        _built[key] = inv.Later(names, buckets, make)
    return replace(index, inverted=_built[key])


def documents(spark: SparkSession, sf_dir: str) -> Index:
    return stored(spark, sf_dir, plain_documents(spark, sf_dir))


def plain_documents(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(read(spark, sf_dir, "documents"), "doc_id", Field("text"), Field("lang", "keyword"), Field("source", "keyword"), Field("n_chars", "long"), name="documents")


def talks(spark: SparkSession, sf_dir: str) -> Index:
    turns = read(spark, sf_dir, "conversations").select(F.xxhash64("conv_id", "turn").alias("doc_id"), "text")
    return stored(spark, sf_dir, Index.of(turns, "doc_id", Field("text"), name="conversations"))


def parts(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(read(spark, sf_dir, "part"), "p_partkey", Field("name", column="p_name"), Field("name_exact", "keyword", "p_name"), Field("brand", "keyword", "p_brand"), Field("type", "keyword", "p_type"), Field("size", "int", "p_size"), Field("price", "double", "p_retailprice"), name="parts")


def orders(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(read(spark, sf_dir, "orders"), "o_orderkey", Field("status", "keyword", "o_orderstatus"), Field("priority", "keyword", "o_orderpriority"), Field("total", "double", "o_totalprice"), Field("day", "date", "o_orderdate", resolution=D.Resolution.DAY), Field("month", "date", "o_orderdate", resolution=D.Resolution.MONTH), Field("daynum", "date", "o_orderdate", resolution=D.Resolution.DAY, numeric=True), name="orders")


def events(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(read(spark, sf_dir, "events"), "event_id", Field("event_type", "keyword"), Field("user_id", "long"), Field("value", "double"), Field("second", "date", "ts", resolution=D.Resolution.SECOND), Field("hour", "date", "ts", resolution=D.Resolution.HOUR, numeric=True), name="events")


def customers(spark: SparkSession, sf_dir: str) -> Index:
    return Index.of(read(spark, sf_dir, "customer"), "c_custkey", Field("balance", "double", "c_acctbal"), Field("segment", "keyword", "c_mktsegment"), name="customers")


def docs_where(query: Q.Query, of=documents, *columns: str) -> Build:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = of(spark, sf_dir)
        return se.matches(index, query).select(index.order, *columns)

    return run


def simple(name: str, sql: str, query: Q.Query, of=documents, *columns: str) -> None:
    QUERIES[name], SQL[name] = docs_where(query, of, *columns), sql


T0 = tok("text")
P0 = tok("p_name")

# ------------------------------------------------------------------ predicates

simple("term_keyword", "SELECT doc_id FROM documents WHERE lang = 'en'", Q.Term("lang", "en"))
simple("term_text", f"SELECT doc_id FROM documents WHERE list_contains({T0}, 'the')", Q.Term("text", "the"))
simple("any_term", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')", Q.AnyTerm("event_type", ("click", "error")), events)
simple("any_term_text", f"SELECT doc_id FROM documents WHERE list_has_any({T0}, ['und', 'der'])", Q.AnyTerm("text", ("und", "der")))
simple("phrase", f"SELECT p_partkey FROM (SELECT p_partkey, {P0} AS t FROM part) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'cold' AND t[i + 1] = 'widget')) > 0", Q.Phrase.of("name", "cold widget"), parts)
simple("prefix_text", f"SELECT p_partkey FROM part WHERE len(list_filter({P0}, lambda x: starts_with(x, 'wi'))) > 0", Q.Prefix("name", "wi"), parts)
simple("prefix_keyword", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')", Q.Prefix("brand", "Brand#1"), parts)
simple("wildcard", "SELECT o_orderkey FROM orders WHERE regexp_full_match(o_orderpriority, '.-.*I.*')", Q.Wildcard("priority", "?-*I*"), orders)
simple("wildcard_text", f"SELECT p_partkey FROM part WHERE len(list_filter({P0}, lambda x: regexp_full_match(x, '.i.*t'))) > 0", Q.Wildcard("name", "?i*t"), parts)
simple("regex_keyword", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[12]3')", Q.Regex("brand", "Brand#[12]3"), parts)
simple("fuzzy_predicate", f"SELECT p_partkey FROM part WHERE len(list_filter({P0}, lambda x: levenshtein(x, 'wigdet') <= 2)) > 0", Q.Fuzzy("name", "wigdet"), parts)
simple("term_range", "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#12' AND p_brand < 'Brand#23'", Q.TermRange("brand", "Brand#12", "Brand#23", True, False), parts)
simple("number_exact", "SELECT p_partkey FROM part WHERE p_size = 15", Q.Number("size", 15, "int"), parts)
simple("number_type_mismatch", "SELECT p_partkey FROM part WHERE false", Q.Number("size", 15, "long"), parts)
simple("number_range", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 20", Q.NumberRange("size", "int", 10, 20, False, True), parts)
simple("number_range_open", "SELECT c_custkey FROM customer WHERE c_acctbal < 100.5", Q.NumberRange("balance", "double", None, 100.5, True, False), customers)
simple("number_range_open_compat", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 1000", Q.NumberRange("balance", "double", None, 1000.0, compat=True), customers)
simple("date_exact_day", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate < TIMESTAMP '1997-03-06'", Q.DateRange.exact("day", datetime(1997, 3, 5)), orders)
simple("date_range_month", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199603' AND '199701'", Q.DateRange("month", datetime(1996, 3, 20), datetime(1997, 1, 2), D.Resolution.MONTH), orders)
simple("date_range_second", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 10:00:00' AND ts < TIMESTAMP '2024-01-09 10:00:01'", Q.DateRange("second", datetime(2024, 1, 3, 10), datetime(2024, 1, 9, 10), D.Resolution.SECOND), events)
simple("date_range_numeric_hour", "SELECT event_id FROM events WHERE epoch_us(ts) // 3600000000 > epoch_us(TIMESTAMP '2024-01-03 10:00:00') // 3600000000", Q.DateRange("hour", datetime(2024, 1, 3, 10, 30), None, D.Resolution.HOUR, True, False), events)
simple("date_mode_mismatch", "SELECT o_orderkey FROM orders WHERE false", Q.DateRange.exact("day", datetime(1997, 3, 5), D.Resolution.DAY, True), orders)
simple("bool_must_should_not", f"SELECT doc_id FROM documents WHERE list_contains({T0}, 'the') AND source <> 'src1'", Q.Bool(((Q.MUST, Q.Term("text", "the")), (Q.SHOULD, Q.Term("text", "and")), (Q.MUST_NOT, Q.Term("source", "src1")))))
simple("bool_should", f"SELECT doc_id FROM documents WHERE lang = 'fr' OR list_contains({T0}, 'of')", Q.Term("lang", "fr") | Q.Term("text", "of"))
simple("bool_only_not", "SELECT doc_id FROM documents WHERE false", Q.Bool(((Q.MUST_NOT, Q.Term("lang", "en")),)))
simple("words_and_or", f"SELECT doc_id FROM documents WHERE list_contains({T0}, 'the') AND (list_contains({T0}, 'of') OR list_contains({T0}, 'in'))", parse_words("text", "the AND (of in)", STANDARD))
simple("words_left_to_right", f"SELECT doc_id FROM documents WHERE (list_contains({T0}, 'der') OR list_contains({T0}, 'the')) AND list_contains({T0}, 'und')", parse_words("text", "der OR the AND und", STANDARD))
simple("question_multi_field", f"SELECT p_partkey FROM part WHERE list_has_any({P0}, ['cold', 'widget']) OR p_type IN ('cold', 'widget')", Question({"name": 2.0, "type": 1.0}, "cold widget", analyzer=STANDARD).query(), parts)
simple("predicate_syntax", f"SELECT p_partkey FROM part WHERE list_contains({P0}, 'widget') AND p_brand >= 'Brand#2' AND p_brand <= 'Brand#4' AND NOT list_contains({P0}, 'cold')", parse_predicate("+name:widget +brand:[Brand#2 TO Brand#4] -name:cold"), parts)
simple("predicate_default_field", f"SELECT p_partkey FROM part WHERE list_contains({P0}, 'cold') AND len(list_filter({P0}, lambda x: starts_with(x, 'wid'))) > 0", parse_predicate("cold AND wid*", "name"), parts)
simple("filter_string", "SELECT event_id FROM events WHERE user_id >= 0 AND event_type = 'click'", Q.string_filter("event_type", click=Q.MUST).apply(Q.Exists("user_id")), events)
simple("filter_string_not", "SELECT event_id FROM events WHERE user_id IS NOT NULL AND event_type <> 'view'", Q.string_filter("event_type", view=Q.MUST_NOT).apply(Q.Exists("user_id")), events)
simple("filter_string_should", "SELECT event_id FROM events WHERE event_type IN ('view', 'click')", Q.string_filter("event_type", view=Q.SHOULD, click=Q.SHOULD).apply(None), events)
simple("filter_numeric", "SELECT p_partkey FROM part WHERE p_size IN (3, 7)", Q.ValueFilter("size", ((3, Q.SHOULD), (7, Q.SHOULD)), "int").apply(None), parts)
simple("filter_date", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-05'", Q.ValueFilter("day", ((datetime(1997, 3, 5), Q.MUST),), "date").apply(None), orders)


@add("SELECT d.doc_id FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL) l USING (doc_id)")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a value, joined from labels."""
    quality = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = read(spark, sf_dir, "documents").select("doc_id").join(quality, "doc_id", "left")
    return se.matches(Index.of(docs, "doc_id", Field("quality", "int")), Q.Exists("quality")).select("doc_id")


@add("SELECT count(*) AS hits FROM orders WHERE o_orderdate IS NULL")
def date_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.count(orders(spark, sf_dir), Q.DateRange("day", None, None)).withColumnRenamed("count", "hits")


# ------------------------------------------------------------------ suggestions as queries

_W = [("name", "co"), ("name", "wi")]


@add(f"SELECT p_partkey FROM part WHERE len(list_filter({P0}, lambda x: starts_with(x, 'co') OR starts_with(x, 'wi'))) > 0")
def suggestion_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.suggestion_predicate(parts(spark, sf_dir), _W).select("p_partkey")


@add(f"SELECT p_partkey FROM part WHERE len(list_filter({P0}, lambda x: starts_with(x, 'co'))) > 0 AND len(list_filter({P0}, lambda x: starts_with(x, 'wi'))) > 0")
def suggestion_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.suggestion_predicate(parts(spark, sf_dir), [*_W, ("name", "zzz")], union=False).select("p_partkey")


@add(f"SELECT p_partkey FROM part WHERE p_size <= 10 AND len(list_filter({P0}, lambda x: starts_with(x, 'co') OR starts_with(x, 'wi'))) > 0")
def suggestion_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.suggestion_predicate(parts(spark, sf_dir), _W, Q.NumberRange("size", "int", None, 10)).select("p_partkey")


# ------------------------------------------------------------------ facets

_EN = Q.Term("lang", "en")


@add("SELECT source AS term, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def facet_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("source").values(documents(spark, sf_dir)).withColumnRenamed("count", "n")


@add("SELECT source AS term, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1 ORDER BY n DESC, term LIMIT 5")
def facet_string_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("source").values(documents(spark, sf_dir), _EN, size=5).withColumnRenamed("count", "n")


@add("SELECT source AS term, count(*) AS n FROM documents WHERE n_chars > 100 AND lang = 'en' GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def facet_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on the facet's own field doesn't apply."""
    base = Q.NumberRange("n_chars", "long", 100, None, False)
    own = [Q.string_filter("source", src1=Q.MUST), Q.string_filter("lang", en=Q.MUST)]
    return fc.FieldFacet("source").values(documents(spark, sf_dir), base, own).withColumnRenamed("count", "n")


@add("SELECT count(*) > 0 AS has_results FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def facet_size0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("source").has_results(documents(spark, sf_dir), _EN)


@add("SELECT source AS term, count(*) AS n FROM documents WHERE false GROUP BY 1")
def facet_max_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("source", max_terms=3).values(documents(spark, sf_dir)).withColumnRenamed("count", "n")


@add("SELECT count(DISTINCT source) AS total FROM documents WHERE lang = 'en'")
def facet_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("source").total(documents(spark, sf_dir), _EN)


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents WHERE lang = 'en') GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def facet_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.FieldFacet("text").values(documents(spark, sf_dir), _EN).withColumnRenamed("count", "n")


@add("SELECT strftime(o_orderdate, '%Y%m') AS term, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_date_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.DateFacet("day", resolution=D.Resolution.MONTH).counts(orders(spark, sf_dir), Q.Term("status", "F")).withColumnRenamed("count", "n")


_SR = (fc.Range("Brand#11", "Brand#15"), fc.Range("Brand#14", "Brand#25", True, False))


@add("SELECT CASE WHEN p_brand BETWEEN 'Brand#11' AND 'Brand#15' THEN 'Brand#11' WHEN p_brand >= 'Brand#14' AND p_brand < 'Brand#25' THEN 'Brand#14' ELSE 'OTHER' END AS min, count(*) AS n FROM part GROUP BY 1")
def facet_string_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.StringRangeFacet("brand", _SR).counts(parts(spark, sf_dir)).select("min", F.col("count").alias("n"))


_NR = (fc.Range(1, 10), fc.Range(5, 20), fc.Range(45, None))


@add("SELECT unnest(['1', '5', '45']) AS min, unnest([count(*) FILTER (p_size BETWEEN 1 AND 10), count(*) FILTER (p_size BETWEEN 5 AND 20), count(*) FILTER (p_size >= 45)]) AS n FROM part")
def facet_num_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.NumericRangeFacet("size", _NR).counts(parts(spark, sf_dir)).select("min", F.col("count").alias("n"))


_DR = (fc.Range(datetime(1995, 1, 1), datetime(1996, 6, 30)), fc.Range(datetime(1996, 1, 1), datetime(1998, 1, 1), True, False))


@add("SELECT CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN '19950101' WHEN CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN '19960101' ELSE 'OTHER' END AS min, count(*) AS n FROM orders GROUP BY 1")
def facet_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.DateRangeFacet("day", _DR).counts(orders(spark, sf_dir)).select("min", F.col("count").alias("n"))


def _sql_intervals(spans: list[fc.Range], value: str, source: str) -> str:
    rows = ", ".join(f"('{r.low}', '{r.high}')" for r in spans)
    return f"SELECT lo AS min, hi AS max, count(*) AS n FROM ({source}) t JOIN (VALUES {rows}) v(lo, hi) ON {value} >= lo AND {value} < hi GROUP BY 1, 2"


@add(_sql_intervals(fc.string_intervals("m", 5), "term", f"SELECT unnest(list_distinct({P0})) AS term FROM part"))
def facet_string_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.StringIntervalFacet("name", "m", 5).counts(parts(spark, sf_dir)).select("min", "max", F.col("count").alias("n"))


@add("SELECT CAST(1000 + 7000 * k AS BIGINT) AS lo, count(*) AS n FROM (SELECT CAST(floor((o_totalprice - 1000) / 7000) AS BIGINT) AS k FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 400000) GROUP BY 1")
def facet_num_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fc.NumericIntervalFacet("total", 1000.0, 400000.0, 7000.0, with_last_max=False).counts(orders(spark, sf_dir))
    return found.select(F.col("min").cast("double").cast("bigint").alias("lo"), F.col("count").alias("n"))


_DI = fc.DateIntervalFacet("day", datetime(1997, 1, 31), months=1)
_DI_SPANS = _DI.intervals(datetime(1990, 1, 1), datetime(2005, 1, 1))


@add(_sql_intervals([fc.Range(r.low.strftime("%Y%m%d"), r.high.strftime("%Y%m%d")) for r in _DI_SPANS], "term", "SELECT strftime(o_orderdate, '%Y%m%d') AS term FROM orders"))
def facet_date_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _DI.counts(orders(spark, sf_dir)).select("min", "max", F.col("count").alias("n"))


@add(
    "WITH t AS (SELECT 'lang' AS field, lang AS term FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT field, term, count(*) AS n FROM t WHERE term IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY field) AS total, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS k FROM c) SELECT field, term, n, total FROM r WHERE k <= 10"
)
def facet_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.many(documents(spark, sf_dir), None, ["lang", "source"]).withColumnRenamed("count", "n")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents UNION ALL SELECT unnest(list_distinct({T0})) FROM conversations) GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def facet_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = union(documents(spark, sf_dir), talks(spark, sf_dir))
    return fc.FieldFacet("text").values(both, size=20).withColumnRenamed("count", "n")


# ------------------------------------------------------------------ sorting, paging, counting


@add("SELECT p_partkey, p_brand FROM part ORDER BY p_brand, p_partkey LIMIT 20")
def sort_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts(spark, sf_dir)
    return se.top(index, index.df, ["brand"]).select("p_partkey", "p_brand")


@add("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def sort_number_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts(spark, sf_dir)
    return se.top(index, index.df, ["-size"]).select("p_partkey", "p_size")


@add(f"SELECT p_partkey, list_min({P0}) AS least FROM part ORDER BY least DESC, p_partkey LIMIT 20")
def sort_multi_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts(spark, sf_dir)
    words = index.df.select("p_partkey", index.tokens("name").alias("words"))
    many = Index.of(words, "p_partkey", Field("words", "keyword", multi=True))
    return se.top(many, words, ["-words"]).select("p_partkey", F.array_min("words").alias("least"))


@add("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 15 OFFSET 15")
def page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search(documents(spark, sf_dir), _EN, ["doc"], se.Page(2, 15)).page_df.select("doc_id")


@add("SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.count(documents(spark, sf_dir), _EN).withColumnRenamed("count", "n")


@add("SELECT count(source) AS n FROM documents WHERE lang = 'en'")
def field_doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.count_with(documents(spark, sf_dir), _EN, "source").withColumnRenamed("count", "n")


@add("SELECT count(*) > 0 AS found FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def field_doc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.any_with(documents(spark, sf_dir), _EN, "source")


@add("SELECT DISTINCT doc_id FROM documents WHERE lang = 'de'")
def matching_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.ids(documents(spark, sf_dir), Q.Term("lang", "de"))


@add("SELECT unnest(['lang', 'source', 'absent']) AS field, unnest([count(lang) > 0, count(source) > 0, false]) AS found FROM documents")
def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.fields_present(documents(spark, sf_dir), None, ["lang", "source", "absent"])


_BM = (
    "WITH d AS (SELECT doc_id, {t} AS t FROM documents), s AS (SELECT avg(len(t)) FILTER (len(t) > 0) AS a, CAST(count(*) FILTER (len(t) > 0) AS DOUBLE) AS n, "
    "CAST(count(*) FILTER (list_contains(t, 'the')) AS DOUBLE) AS f1, CAST(count(*) FILTER (list_contains(t, 'are')) AS DOUBLE) AS f2 FROM d), "
    "x AS (SELECT doc_id, len(list_filter(t, lambda y: y = 'the')) AS c1, len(list_filter(t, lambda y: y = 'are')) AS c2, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / a) AS k, n, f1, f2 FROM d, s) "
    "SELECT doc_id, round(ln(1 + (n - f1 + 0.5::DOUBLE) / (f1 + 0.5::DOUBLE)) * c1 / (c1 + k) + 2 * ln(1 + (n - f2 + 0.5::DOUBLE) / (f2 + 0.5::DOUBLE)) * c2 / (c2 + k), 4) AS score FROM x WHERE c1 > 0 OR c2 > 0 ORDER BY score DESC, doc_id LIMIT 20"
).format(t=T0)


@add(_BM)
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = se.bm25(documents(spark, sf_dir), Q.Term("text", "the") | Q.Boost(Q.Term("text", "are"), 2.0))
    return scored.select("doc_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


# ------------------------------------------------------------------ terms


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents) GROUP BY 1")
def terms_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.dictionary(documents(spark, sf_dir), "text").withColumnRenamed("count", "n")


_POST = f"SELECT doc_id AS doc, t, len(t) AS length, unnest(t) AS term FROM (SELECT doc_id, {T0} AS t FROM documents)"


@add(f"SELECT term, doc, count(*) AS tf, any_value(length) AS length FROM (SELECT doc, term, length FROM ({_POST})) GROUP BY term, doc")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).postings(["text"]).select("term", "doc", "tf", F.col("length").cast("bigint").alias("length"))


@add(f"SELECT 'text' AS field, count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS length FROM (SELECT {T0} AS t FROM documents)")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the inverted index of the documents anew; its statistics."""
    return stored(spark, sf_dir, plain_documents(spark, sf_dir), build=True).inverted.statistics


@add(f"SELECT doc_id FROM documents WHERE list_contains({T0}, 'the')")
def term_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as term_text without a stored index."""
    return se.matches(plain_documents(spark, sf_dir), Q.Term("text", "the")).select("doc_id")


@add(f"SELECT count(*) AS n FROM documents WHERE list_contains({T0}, 'the')")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.doc_freq(documents(spark, sf_dir), "text", "the").withColumnRenamed("count", "n")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents) WHERE starts_with(term, 'th') AND term <> 'th' GROUP BY 1")
def prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.prefixed(documents(spark, sf_dir), "text", "th", exact=False).withColumnRenamed("count", "n")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({T0})) AS term FROM documents) WHERE levenshtein(regexp_replace(term, '[^a-z0-9_]', '#', 'g'), 'the') BETWEEN 1 AND 2 GROUP BY 1")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.fuzzy(documents(spark, sf_dir), "text", "the").withColumnRenamed("count", "n")


@add(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({P0})) AS term FROM part) WHERE damerau_levenshtein(term, 'wigdet') BETWEEN 1 AND 2 OR (starts_with(term, 'wigdet') AND term <> 'wigdet') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.similar(parts(spark, sf_dir), ["name"], "wigdet").withColumnRenamed("count", "n")


@add(f"SELECT 'name' AS field, term FROM (SELECT DISTINCT unnest({P0}) AS term FROM part) WHERE starts_with(term, 'wi') UNION SELECT 'brand', 'Brand#12'")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te.extract(Q.Prefix("name", "wi") | Q.Term("brand", "Brand#12"), parts(spark, sf_dir))


# ------------------------------------------------------------------ autosuggestion


@add(f"SELECT term AS text, '<b>wi</b>' || substr(term, 3) AS highlight FROM (SELECT DISTINCT unnest({P0}) AS term FROM part) WHERE starts_with(term, 'wi') ORDER BY term LIMIT 10")
def autosuggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    how, index = su.AutoSuggest(("name",), terms=True), parts(spark, sf_dir)
    return how.suggest(how.build(index), "wi").select("text", "highlight")


@add(f"SELECT p_partkey AS doc, p_name AS text, CAST(p_size * 100 AS BIGINT) AS weight FROM part WHERE p_brand = 'Brand#12' AND list_contains({P0}, 'cold') AND len(list_filter({P0}, lambda x: starts_with(x, 'w'))) > 0 ORDER BY weight DESC, text, doc LIMIT 10")
def autosuggest_criteria_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts(spark, sf_dir)
    how = su.AutoSuggest(("name_exact",), criteria="brand", weights={"p_size": 1.0}, returned=("type",))
    return how.suggest(how.build(index), "cold w", ["Brand#12"]).select("doc", "text", "weight")


# ------------------------------------------------------------------ functions


@add("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS s, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS d, epoch_us(ts) // 3600000000 AS h, strftime(ts, '%Y-%m-%dT%H:%M') AS iso FROM events")
def dates_at_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    R, ts = D.Resolution, F.col("ts")
    return read(spark, sf_dir, "events").select("event_id", D.to_string(ts, R.SECOND).alias("s"), D.to_number(ts, R.DAY).alias("d"), D.to_number(ts, R.HOUR).alias("h"), D.to_iso(ts, R.MINUTE).alias("iso"))


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def dates_from_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", D.string_to_iso(D.to_string(F.col("ts"), D.Resolution.SECOND)).alias("iso"))


@add("SELECT p_partkey, regexp_replace(p_name, '(?i)\\b(widget)\\b', '<term>\\1</term>') AS extract FROM part WHERE regexp_matches(p_name, '(?i)\\bwidget\\b')")
def extract_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", extract(F.col("p_name"), "widget", 200).alias("extract")).where("extract is not null")


@add()
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fragment of every document with one of two words."""
    return read(spark, sf_dir, "documents").select("doc_id", highlight(F.col("text"), {"the": 1.0, "und": 1.0}, 80).alias("fragment")).where("fragment is not null")


@add("SELECT page_id, CASE WHEN length(url) < 30 THEN url END AS url FROM pages")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.render(read(spark, sf_dir, "pages").select("page_id", "url"), 30)


# ------------------------------------------------------------------ changes

_H1 = "SELECT event_id, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-15'"
_H2 = "SELECT max_by(event_id, event_id) AS event_id, user_id, event_type, max_by(value, event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id, event_type"


@add(f"WITH a AS ({_H1}), b AS ({_H2}) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id) UNION ALL SELECT * FROM b")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows take the place of all old ones with the same key."""
    df = read(spark, sf_dir, "events")
    old = df.where("ts < timestamp '2024-01-15'").select("event_id", "user_id", "event_type", "value")
    late = df.where("ts >= timestamp '2024-01-15'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"), F.max_by("value", "event_id").alias("value"))
    return st.merged(old, late.select(F.col("last").alias("event_id"), "user_id", "event_type", "value"), "user_id")


@add("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND user_id IS NOT NULL)")
def delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = events(spark, sf_dir)
    query = Q.Bool(((Q.MUST, Q.Exists("user_id")), (Q.MUST_NOT, Q.Term("event_type", "error"))))
    return se.matches(index, query).select("event_id").unionByName(index.df.where("user_id is null").select("event_id"))


@add("SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS value FROM events")
def update_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return st.updated(df, F.col("event_type") == "error", "value", F.lit(-1.0)).select("event_id", "value")


@add("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts, event_id) AS k FROM events) WHERE k = 1")
def dedupe_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("priority", F.when(F.col("value") > 50, jobs.HIGH).otherwise(jobs.LOW))
    return jobs.without_similar(df, ["user_id", "event_type"], tie="event_id").select("event_id")


@add(
    "WITH a AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, event_type, k"
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.debounce(read(spark, sf_dir, "events"), ["user_id", "event_type"], "12 hours").drop("fires")


@add(
    "WITH k AS (SELECT user_id AS id, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), f AS (SELECT user_id AS id, max(ts) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1) SELECT CAST(coalesce(f.id, k.id) AS VARCHAR) AS path, CASE WHEN k.id IS NULL THEN 'insert' WHEN f.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM f FULL JOIN k ON f.id = k.id WHERE k.id IS NULL OR f.id IS NULL OR f.m > k.m"
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    latest = lambda part: part.groupBy("path").agg(F.max("ts").alias("modified"))
    return changes(latest(df.where("ts >= timestamp '2024-01-05'")), latest(df.where("ts < timestamp '2024-01-10'")))


@add("SELECT page_id, CASE WHEN starts_with(url, 'https://') AND regexp_matches(url, '^https://[^/]+') THEN 'site-' || regexp_extract(url, '^https://([^/]+)', 1) END AS index_name FROM pages")
def index_name_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", route([Route("site-{name}", "https://{name}")], F.col("url")).alias("index_name"))


@add("SELECT name, CASE WHEN name = 'k' THEN 'int' ELSE 'keyword' END AS type FROM (SELECT DISTINCT unnest(json_keys(props)) AS name FROM events)")
def catalog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the fields of events' JSON properties, the first definition of each name."""
    props = read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    kind = F.when(F.col("value").try_cast("int").isNotNull(), F.lit("int"))
    found = st.fold_catalog(props.select(F.col("event_id").alias("ordinal"), "name", kind.alias("type"), F.lit(False).alias("tokenize"), F.lit("none").alias("doc_values"), F.lit(None).cast("string").alias("date_format"), F.lit(None).cast("string").alias("resolution"), F.lit(False).alias("multi")))
    return spark.createDataFrame([(f.name, f.type) for f in found.fields.values()], "name string, type string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search with paging over documents."""
    return se.search(documents(spark, sf_dir), Q.Term("text", "the") & Q.Term("lang", "en")).page_df.select("doc_id", "source", F.round("score", 4).alias("score"))


