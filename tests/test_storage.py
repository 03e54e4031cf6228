"""XML records, catalogs, storage, streams, routes and texts."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievelight.functions import dates as D
from sievelight.functions.highlight import extract, fragments, highlight
from sievelight.operators import search as se
from sievelight.operators import store as st
from sievelight.operators import terms as te
from sievelight.plans import nodes as Q
from sievelight.schema import Catalog, Field, parse_doc_values, parse_index, parse_numeric
from sievelight.service import Config, Engine
from sievelight.sources.fields_xml import definitions, read
from sievelight.sources.folders import Translators, changes, listing, media_type, relative_path
from sievelight.sources.routes import Route, file_filter, is_valid_index_name
from sievelight.streaming import jobs

XML = """<documents version="5.0"><document><field name="id" tokenize="false">{0}a</field><field name="text">the  green frog {0}</field><field name="n" numeric-type="int">{0}</field><field name="day" tokenize="false" date-format="yyyy-MM-dd" date-resolution="day">2015-05-1{0}</field></document>
<document><field name="id" tokenize="false">{0}b</field><field name="text"/><field name="n" numeric-type="int">x</field><field name="day" tokenize="false" date-format="yyyy-MM-dd" date-resolution="day"></field><field name="tag" tokenize="false">p</field><field name="tag" tokenize="false">q</field></document><document/></documents>"""


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "content"
    at.mkdir()
    for k in (1, 2):
        (at / f"doc{k}.xml").write_text(XML.format(k))
    return at


def test_xml_to_typed_columns(spark, folder):
    raw = read(spark, str(folder)).withColumn("ord", F.monotonically_increasing_id())
    assert raw.count() == 4
    catalog = st.fold_catalog(definitions(raw, "ord"))
    kinds = {f.name: f.type for f in catalog.fields.values()}
    assert kinds == {"id": "keyword", "text": "text", "n": "int", "day": "date", "tag": "keyword"} and catalog.fields["tag"].multi
    typed, warned = st.convert(raw.select("fields", "ord"), catalog)
    rows = {r.id: r for r in typed.collect()}
    assert rows["1a"].n == 1 and rows["1b"].n is None and rows["1b"].text == "" and rows["1a"].text == "the  green frog 1"
    assert rows["2b"].tag == ["p", "q"] and rows["1a"].day == datetime(2015, 5, 11) and rows["1b"].day is None
    assert {tuple(r) for r in warned.collect()} == {("n", "x")}
    with pytest.raises(ValueError):
        read(spark, str(folder), "1.0")


def test_engine_keeps_up_with_a_folder(spark, folder, tmp_path):
    engine = Engine(spark, Config(root=str(tmp_path / "indexes")))
    first = engine.index_folder("default", str(folder))
    assert first["version"] == 1 and first["insert"] == 2
    engine.open("default", "_ord")
    assert engine.term_search("text", "frog").total() == 2
    time.sleep(1.1)
    (folder / "doc3.xml").write_text(XML.format(3))
    os.remove(folder / "doc1.xml")
    second = engine.index_folder("default", str(folder))
    assert second.get("insert") == 1 and second.get("delete") == 1
    engine.open("default", "_ord")
    assert {r.id for r in engine.select().df.collect()} == {"2a", "2b", "3a", "3b"}
    found, facets = engine.basic_search("green frog", "text", facets=["id"])
    assert found.total() == 2 and facets.count() == 2
    assert engine.predicate_search("text:frog AND id:2a").total() == 1
    assert engine.get_facets(facets=["tag"]).count() == 2
    assert [r.text for r in engine.auto_suggest("fr", ["text"], terms=True).collect()] == ["frog"]
    assert engine.lookup_prefix("fr", "text").count() == 1 and engine.lookup_fuzzy("frgo", "text").count() == 1 and engine.lookup_similar("gren", ["text"]).count() == 1
    assert engine.index_summary()["documents"] == 4 and engine.list_indexes() == ["default"] and len(engine.get_batches()) == 2
    assert engine.index_terms("tag").count() == 2 and len(engine.catalog()) == 5
    assert engine.clear_index("default") == 3 and engine.store("default").read().count() == 0
    engine.delete_index("default")
    with pytest.raises(KeyError):
        engine.select()


def test_store(spark, tmp_path):
    store = st.IndexStore(spark, str(tmp_path / "i"), {"v": Field("v"), "k": Field("k", "int")})
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    held = lambda: {tuple(r) for r in store.read().select("k", "v").collect()}
    assert not store.exists() and store.upsert(rows((1, "a x"), (2, "b x")), "k") == 1
    snapshot = store.read()
    store.upsert(rows((2, "c x"), (3, "d x"), (None, "n")), "k")
    assert held() == {(1, "a x"), (2, "c x"), (3, "d x"), (None, "n")} and snapshot.count() == 2
    store.upsert(rows((3, "e")), None)
    assert store.read().count() == 5
    numbers = [r._ord for r in store.index().df.collect()]
    assert len(set(numbers)) == 5
    # Postings follow what is visible
    index = store.index()
    assert index.reads_postings(["v"]) and {r.term: r["count"] for r in te.dictionary(index, "v").collect()} == {"a": 1, "c": 1, "d": 1, "e": 1, "n": 1, "x": 3}
    assert {r.k for r in se.matches(index, Q.Term("v", "x")).collect()} == {1, 2, 3}
    store.delete(F.col("k") == 3)
    store.delete_matching(Q.Term("v", "n"))
    assert held() == {(1, "a x"), (2, "c x")}
    # A value set for sorting moves a document, but is neither searched nor shown
    store.update(F.col("k") == 1, "k", F.lit(9))
    index = store.index()
    assert [r.k for r in se.top(index, index.df, ["-k"]).collect()] == [1, 2] and held() == {(1, "a x"), (2, "c x")}
    assert se.matches(index, Q.Number("k", 9, "int")).count() == 0 and {r._ord for r in index.df.collect()} < set(numbers)
    before = sorted((r._ord, r.v) for r in index.df.collect())
    version = store.compact()
    assert sorted((r._ord, r.v) for r in store.index().df.collect()) == before and len(store.manifest()["segments"]) == 1
    # A second writer that made the same version is told so, and what was begun but not named isn't seen
    with pytest.raises(FileExistsError):
        store._create(f"manifest-{version:08d}.json", "{}")
    rows((7, "lost")).write.parquet(str(tmp_path / "i" / "s000099-1" / "docs"))
    assert store.version() == version and held() == {(1, "a x"), (2, "c x")}
    store.vacuum(1)
    left = sorted(p.name for p in (tmp_path / "i").iterdir() if not p.name.startswith("."))
    assert len(left) == 2 and left[0] == f"manifest-{version:08d}.json" and held() == {(1, "a x"), (2, "c x")}
    store.clear()
    assert store.read().count() == 0 and store.append(rows((5, "z"))) and held() == {(5, "z")}


def test_catalog():
    c = Catalog()
    c.register(Field("a", "int"))
    with pytest.warns(UserWarning):
        assert c.register(Field("a", "text")).type == "int"
    c.register(Field("b", "date", resolution=D.Resolution.DAY, indexed=False))
    assert not c.is_tokenized("unknown") and c.by_prefix("a") == ["a"] and c.numeric_type("a") == "int"
    assert Catalog.from_json(c.to_json()).fields == c.fields
    assert parse_doc_values("sorted", True) == "sorted-numeric" and parse_numeric("INT") == "int" and parse_index(None).endswith("offsets")
    assert D.Resolution.of("odd") is D.Resolution.DAY


def test_stream_upserts(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "a", 1, False), (2, "b", 1, False)], [(1, "c", 2, False), (2, "b", 2, True), (3, "d", 2, False)]
    store = st.IndexStore(spark, str(tmp_path / "s"))
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "k int, v string, at int, gone boolean").write.mode("append").parquet(str(source))
        stream = jobs.watch(spark, str(source), "k int, v string, at int, gone boolean")
        query = jobs.upsert_stream(stream, store, "k", ["at"], "gone", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r.k, r.v) for r in store.read().collect()} == {(1, "c"), (3, "d")}


def test_jobs(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("x", "LOW", t(0), "put"), ("x", "HIGH", t(5), "put"), ("y", "LOW", t(1), "put"), ("y", "LOW", t(30), "clear"), ("y", "LOW", t(40), "put")], "index string, priority string, ts timestamp, kind string")
    assert [(r["index"], r.priority) for r in jobs.in_order(jobs.without_similar(df, ["index"])).collect()] == [("x", "HIGH"), ("y", "LOW")]
    assert {(r["index"], r.ts.second) for r in jobs.after_clear(df).collect()} == {("x", 0), ("x", 5), ("y", 30), ("y", 40)}
    runs = jobs.debounce(df, ["index"], "10 seconds")
    assert {(r["index"], r.n) for r in runs.collect()} == {("x", 2), ("y", 1), ("y", 2)}


def test_changes_and_folders(spark, folder):
    files = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "path string, modified int")
    known = spark.createDataFrame([("b", 1), ("c", 0), ("d", 1)], "path string, modified int")
    assert {tuple(r) for r in changes(files, known).collect()} == {("a", "insert"), ("c", "update"), ("d", "delete")}
    assert listing(spark, str(folder), r"doc1\.xml$").count() == 1
    out = Translators().translate(listing(spark, str(folder), content=True)).collect()
    assert len(out) == 2 and all("frog" in r.text and r.media == "application/xml" for r in out)
    assert media_type("x.pdf") == "application/octet-stream" and Translators().get("image/svg+xml")
    assert relative_path("/a/b", "/a/b/c") == "/c" and relative_path("/a/b", "/a/bc") is None


def test_routes():
    r = Route("index", "/notes/content")
    assert r.index_of("/notes/content/something") == "index" and r.index_of("/notes/contents/something") is None
    r = Route("index-{name}", "/notes/content/book{name}/folder")
    assert r.index_of("/notes/content/book001/folder") == "index-001" and r.content_path("index-001") == "/notes/content/book001/folder"
    r = Route("book-{name}", "/notes/content/book-{name}", ("/notes/content/book-002", "/notes/content/book-10*"))
    assert [r.index_of(f"/notes/content/book-{n}") for n in ("101", "111", "002")] == [None, "book-111", None]
    r = Route("index-{name}", "/x/{name}")
    assert r.clashes("index-more-{name}") and not r.clashes("more-{name}") and not r.clashes("index") and Route("index-{name}", "/{name}").clashes("{name}-index")
    with pytest.raises(ValueError):
        Route("i-{name}", "/fixed")
    assert is_valid_index_name("a-b.c@$") and not is_valid_index_name("a b") and not is_valid_index_name("x" * 256)
    args = dict(include=r"test/(.*)\.notes", exclude=r"test/notme\.notes", extensions=("notes", "xml"))
    assert [file_filter(p, **args) for p in ("test/test.notes", "test.notes", "test/test.xml", "test.zip", "test/notme.notes")] == [True, False, False, False, False]


LIPSUM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


def test_texts(spark):
    assert fragments(LIPSUM, {"ipsum": 1.0}, 20) == ["Lorem <term>ipsum</term> dolor"]
    assert fragments(LIPSUM, {"lorem": 1.0}, 5) == ["<term>Lorem</term>"]
    assert fragments(LIPSUM, {"absent": 1.0}, 5) == []
    assert fragments("a & b > c", {"b": 1.0}, 99, marker="m") == ["a &amp; <m>b</m> &gt; c"]
    df = spark.createDataFrame([(LIPSUM,), (None,), ("nothing",)], "t string")
    assert [r[0] for r in df.select(highlight(F.col("t"), {"ipsum": 1.0}, 20)).collect()] == ["Lorem <term>ipsum</term> dolor", None, None]
    cut = [r[0] for r in df.select(extract(F.col("t"), "adipiscing", 40)).collect()]
    assert cut[0].startswith("...") and "<term>adipiscing</term>" in cut[0] and cut[1:] == [None, None]
    whole = spark.createDataFrame([("a <b> Word c",)], "t string").select(extract(F.col("t"), "word", 50)).first()[0]
    assert whole == "a &lt;b&gt; <term>Word</term> c"
    with pytest.raises(ValueError):
        extract(F.col("t"), "long", 2)


def test_dates(spark):
    df = spark.createDataFrame([(datetime(2015, 5, 12, 17, 15, 33, 250000),)], "t timestamp")
    R, t = D.Resolution, F.col("t")
    row = df.select(D.to_string(t, R.MILLISECOND), D.to_string(t, R.MONTH), D.to_number(t, R.DAY), D.to_number(t, R.HOUR), D.to_iso(t, R.MINUTE)).first()
    assert tuple(row) == ("20150512171533250", "201505", 20150512, 397625, "2015-05-12T17:15")
    iso = spark.createDataFrame([("20150512",), ("201505",), ("20150512171533",), ("2015x",)], "s string").select(D.string_to_iso(F.col("s"))).collect()
    assert [r[0] for r in iso] == ["2015-05-12", "2015-05", "2015-05-12T17:15:33Z", None]
    assert D.step_after(datetime(2015, 12, 31), R.MONTH).year == 2016


def test_records_go_to_files_of_bounded_size(spark, tmp_path):
    """A partition of records is several files, each whole by itself, which are read without an exchange by file."""
    from sievelight.sources import fields_xml as xml

    rows = [(i, "long " * 50 if i == 77 else f"a <b> & {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "n bigint, t string").coalesce(1)
    xml.write_records(df, str(tmp_path / "r"), {"n": 'numeric-type="long"'}, most=1000)
    files = sorted((tmp_path / "r").glob("part-*.txt"))
    assert len(files) > 10 and all(f.stat().st_size < 1400 for f in files)
    assert all(f.read_text().startswith('<documents version="5.0">') and f.read_text().rstrip().endswith("</documents>") for f in files)
    back = xml.read(spark, str(tmp_path / "r"))
    got = back.select(F.col("fields")[0]["value"].cast("long").alias("n"), F.col("fields")[1]["value"].alias("t")).collect()
    assert sorted(map(tuple, got)) == rows
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert xml.validate(spark, str(tmp_path / "r")).count() == 0
    xml.write_records(df.limit(0), str(tmp_path / "none"))
    assert xml.read(spark, str(tmp_path / "none")).count() == 0 and xml.validate(spark, str(tmp_path / "none")).count() == 0


def test_postings_of_documents_that_went(spark, tmp_path, monkeypatch):
    """By bits, without an exchange of postings by document, and by a join where there are too many blocks."""
    numbers = [*range(0, 200), 2**33, 2**33 + 63, 2**33 + 64, 2**40 - 1]
    went = [0, 1, 62, 63, 64, 127, 128, 199, 2**33 + 63, 2**40 - 1, 1000]
    postings = spark.createDataFrame([("t", f"w{d % 3}", d) for d in numbers], "field string, term string, doc bigint")
    gone = spark.createDataFrame([(d,) for d in [*went, 64]], "__gone bigint")
    want = sorted(set(numbers) - set(went))
    for blocks in (st.BLOCKS, 2):
        monkeypatch.setattr(st, "BLOCKS", blocks)
        left = st.without_gone(postings, gone)
        assert left.columns == ["field", "term", "doc"] if blocks > 2 else set(left.columns) == {"field", "term", "doc"}
        assert sorted(r.doc for r in left.collect()) == want
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "hashpartitioning(doc" not in plan) or blocks == 2
