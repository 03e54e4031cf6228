"""The engine: ingest, catalogs, watched folders, progress, listeners, administration."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sievelight.operators import search as se
from sievelight.plans import nodes as Q
from sievelight.schema import Catalog, Field, parse_date_format
from sievelight.service import Batch, Config, Engine, Listener
from sievelight.sources import fields_xml as xml
from sievelight.sources import folders as fo
from sievelight.sources.routes import file_filter

RECORD = '<documents version="{v}"{zone}>\n{docs}</documents>'
DOC = '<document><field name="id" tokenize="false">{0}</field><field name="text">green frog {0}</field>{1}</document>'


def put(folder, name, docs, v="5.0", zone=""):
    (folder / name).write_text(RECORD.format(v=v, zone=zone, docs="".join(docs)))


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "content"
    at.mkdir()
    put(at, "a.xml", [DOC.format("a", "")])
    put(at, "b.xml", [DOC.format("b", "")])
    return at


def test_a_later_ingest_keeps_new_fields_and_reads_only_what_changed(spark, folder, tmp_path):
    told = []

    class Tell(Listener):
        def start_batch(self, batch):
            told.append(("start", batch.index))

        def warn(self, batch, message):
            told.append(("warn", message))

        def end_batch(self, batch):
            told.append(("end", batch.finished))

        def error(self, batch, error):
            told.append(("error", type(error).__name__))

    read = []
    engine = Engine(spark, Config(root=str(tmp_path / "i")), listener=Tell())
    engine.fetchers["default"] = lambda spark, paths: (read.append(sorted(p.rpartition("/")[2] for p in paths)), xml.read(spark, paths))[1]
    engine.index_folder("default", str(folder))
    first = engine.etag()
    time.sleep(1.1)
    put(folder, "c.xml", [DOC.format("c", '<field name="brandnew" tokenize="false">x</field><field name="n" numeric-type="int">7</field><field name="n" numeric-type="int">bad</field>')])
    os.remove(folder / "a.xml")
    done = engine.index_folder("default", str(folder), requester="me")
    assert done["insert"] == 1 and done["delete"] == 1 and read == [["a.xml", "b.xml"], ["c.xml"]] and engine.etag() != first
    index = engine.open("default")
    rows = {r.id: r for r in index.df.collect()}
    assert set(rows) == {"b", "c"} and rows["c"].brandnew == "x" and rows["b"].brandnew is None and rows["c"].n == [7]
    assert {f["name"] for f in engine.catalog()} >= {"id", "text", "brandnew", "n"} and index.reads_postings(["text"])
    assert {r.id for r in se.matches(index, Q.Term("text", "frog")).collect()} == {"b", "c"} and len({r._ord for r in rows.values()}) == 2
    assert engine.index_folder("default", str(folder))["version"] == done["version"]  # nothing changed
    assert [b["requester"] for b in engine.get_batches()] == ["", "me", ""] and engine.check_progress("default") is None and ("warn", "n can't be bad") in told
    put(folder, "d.xml", [DOC.format("d", "")], v="1.0")
    with pytest.raises(xml.UnknownVersion):
        engine.index_folder("default", str(folder))
    assert told[-2:] == [("error", "UnknownVersion"), ("end", True)] and engine.get_batches()[-1]["problem"]
    other = Engine.local(spark, str(tmp_path / "i"))
    assert other.list_indexes() == ["default"] and other.exists("default") and not other.exists("no/name")
    engine.running["default"] = Batch("default", total=4, current=1)
    with pytest.raises(RuntimeError):
        engine.index_folder("default", str(folder))
    assert engine.check_progress("default")["current"] == 1


def test_versions_zones_and_validation(spark, folder):
    old = '<document><field name="at" index="not-analyzed" date-format="yyyy-MM-dd HH:mm" date-resolution="minute">2020-01-02 03:04</field><field name="day" index="not-analyzed" date-format="yyyy-MM-dd">2020-01-02</field></document>'
    put(folder, "old.xml", [old], v="2.0", zone=" timezone='+02:00'")
    got = {r.file.rpartition("/")[2]: (r.version, r.timezone) for r in xml.versions(spark, str(folder)).collect()}
    assert got == {"a.xml": ("5.0", None), "b.xml": ("5.0", None), "old.xml": ("2.0", "+02:00")}
    fields = {f.name: f.timezone for r in xml.read(spark, str(folder)).where("file like '%old.xml'").collect() for f in r.fields}
    assert fields == {"at": "+02:00", "day": "GMT"}
    assert [r.asDict() for r in xml.validate(spark, str(folder)).collect()] == []
    (folder / "bad.xml").write_text('<documents version="5.0"><document>\n<field\n name="x" date-resolution="week" size="1">a > b</field></document></documents>')
    (folder / "none.xml").write_text("<other/>")
    found = {(r.file.rpartition("/")[2], r.problem) for r in xml.validate(spark, str(folder)).collect()}
    assert found == {("bad.xml", "date-resolution can't be week"), ("bad.xml", "no attribute size"), ("none.xml", "no documents of a version")}


def test_a_watched_folder_follows_deletes(spark, folder, tmp_path):
    engine = Engine(spark, Config(root=str(tmp_path / "i")))
    engine.index_folder("default", str(folder))
    put(folder, "c.xml", [DOC.format("c", "")])
    os.remove(folder / "b.xml")
    query = engine.watch("default", str(folder), "0 seconds", rounds=2, checkpoint=str(tmp_path / "c"))
    try:
        end = time.time() + 90
        while time.time() < end and {r.id for r in engine.store("default").read().collect()} != {"a", "c"}:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {r.id for r in engine.store("default").read().collect()} == {"a", "c"}


def test_administration(spark, tmp_path):
    c = Config.from_keys({"index.types": "one,two,broken", "index.one.name": "book-{name}", "index.one.path": "/b/{name}", "index.one.files.includes": ".*", "index.two.name": "book-x", "index.two.path": "/x", "watcher.excludes": "a,b", "threads.number": "3", "debounce": "20"})
    assert [r.name for r in c.routes] == ["book-{name}"] and c.ignored == ("two", "broken") and c.watch_excludes == ("a", "b") and c.threads == 3 and c.debounce == "20 milliseconds" and c.files["one"] == (".*", None)
    engine = Engine.local(spark, str(tmp_path / "i"))
    catalog = Catalog()
    catalog.register(Field("text"))
    assert engine.create("empty", catalog).df.count() == 0 and engine.list_indexes() == ["empty"] and engine.get_config().root.endswith("i")
    engine.mappings = {("default", "application/xml"): lambda df: df, ("x", "y"): lambda df: df.select("nope")}
    said = engine.check_mappings(spark.createDataFrame([(1,)], "fields int"))
    assert said[("default", "application/xml")] is None and "nope" in said[("x", "y")]
    engine.close()
    assert engine.list_indexes() == []
    assert parse_date_format("yyyy-MM-dd'T'HH") and not parse_date_format("bb") and not parse_date_format("yyyy'")


def test_suggestions_are_rebuilt_for_a_new_version(spark, folder, tmp_path):
    engine = Engine(spark, Config(root=str(tmp_path / "i")))
    engine.index_folder("default", str(folder))
    engine.open("default")
    assert [r.text for r in engine.auto_suggest("fr", ["text"], terms=True).collect()] == ["frog"]
    built = next(iter(engine.suggesters.values()))
    engine.auto_suggest("gr", ["text"], terms=True)
    assert next(iter(engine.suggesters.values())) is built
    time.sleep(1.1)
    put(folder, "c.xml", [DOC.format("c", '<field name="text">frost</field>')])
    engine.index_folder("default", str(folder))
    engine.open("default")
    assert [r.text for r in engine.auto_suggest("fr", ["text"], terms=True).collect()] == ["frog", "frost"]


def test_translators_tell_what_they_leave_out(spark, tmp_path):
    for name, text in (("a.txt", "long enough"), ("b.bin", "12345"), ("c.bin", "123"), ("d.pdf", "x"), ("e.html", "<p>hi</p>")):
        (tmp_path / name).write_text(text)
    t = fo.Translators(largest=4)
    t.media["bin"] = "application/bin"
    t.register("application/bin", lambda b: b.decode(), binary=True)
    t.register("text/html", lambda b: 1 / 0)
    got = {r.path.rpartition("/")[2]: (r.text, r.problem) for r in t.translate(fo.listing(spark, str(tmp_path), content=True)).collect()}
    assert got["a.txt"] == ("long enough", None) and got["b.bin"][0] is None and "bytes" in got["b.bin"][1] and got["c.bin"] == ("123", None) and got["d.pdf"] == (None, "no translator") and "ZeroDivision" in got["e.html"][1]
    assert file_filter("x/A.PSML", extensions=("psml",)) and not file_filter("x.d/psml", extensions=("psml",))


def test_records_written_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a & b < "c"', ["x", "y"]), (2, None, None)], "n int, t string, many array<string>")
    xml.write_records(df, str(tmp_path / "r"), {"n": 'numeric-type="int"'})
    got = {tuple(sorted((f.name, f.value) for f in r.fields)) for r in xml.read(spark, str(tmp_path / "r")).collect()}
    assert got == {(("many", "x"), ("many", "y"), ("n", "1"), ("t", 'a & b < "c"')), (("n", "2"),)}
    assert xml.to_xml(df.limit(0)).count() == 0 and F is not None
