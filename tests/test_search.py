"""Predicates, languages, sorting and paging over small sets with known results."""

from datetime import datetime

import pytest

from sievelight.functions.analysis import STANDARD, UNICODE, WHITESPACE
from sievelight.functions.dates import Resolution
from sievelight.operators import search as se
from sievelight.operators import suggest as su
from sievelight.operators import terms as te
from sievelight.operators.index import Index, union
from sievelight.plans import nodes as Q
from sievelight.plans.language import Question, SyntaxFault, parse_predicate, parse_words
from sievelight.plans.lower import glob_regex
from sievelight.schema import Catalog, Field


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (1, "doc1", "value1", 1, "I like watermelon", "cccccccc", ["hhhhhhhh", "bbbbbbbb"], 2, datetime(2015, 5, 12, 17, 15, 33)),
        (2, "doc2", "value1 value2", 2, "elementary my dear watson", "bbbbbbbbb", ["wwwwwwwww", "aaaaaaaaa"], 4, datetime(2014, 11, 22, 10, 2, 23)),
        (3, "doc3", "value1 value2 value3", 3, "lion zebra", "ddddddddd", ["mmmmmmmmm", "uuuuuuuuu"], 3, datetime(2015, 7, 4, 21, 11, 55)),
        (4, "doc4", "value1 value2 value4", 4, "elephant tiger", "aaaaaaaa", ["gggggggg", "zzzzzzzz"], 1, None),
    ]
    df = spark.createDataFrame(rows, "ord int, id string, field1 string, field3 int, wildcard string, s1 string, s2 array<string>, s3 int, at timestamp")
    R = Resolution
    return Index.of(df, "ord", Field("id", "keyword"), Field("field1"), Field("field3", "int"), Field("wildcard"), Field("s1", "keyword"), Field("s2", "keyword", multi=True), Field("s3", "int"), Field("day", "date", "at", resolution=R.DAY), Field("sec", "date", "at", resolution=R.SECOND, numeric=True))


def found(index, query):
    return [r.ord for r in se.matches(index, query).orderBy("ord").collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        (Q.Term("field1", "value0"), []),
        (Q.Term("field1", "value1"), [1, 2, 3, 4]),
        (Q.Term("field1", "value2"), [2, 3, 4]),
        (Q.Term("absent", "x"), []),
        (Q.Number("field3", 2, "int"), [2]),
        (Q.Number("field3", 2, "long"), []),
        (Q.Wildcard("wildcard", "ele*"), [2, 4]),
        (Q.Wildcard("wildcard", "water?elon"), [1]),
        (Q.Prefix("wildcard", "wat"), [1, 2]),
        (Q.Phrase.of("field1", "value1 value2"), [2, 3, 4]),
        (Q.Phrase.of("field1", "value2 value1"), []),
        (Q.Phrase.of("field1", "value1  value2"), []),
        (Q.Phrase("field1", ("value1", "value3"), 1), [3]),
        (Q.Phrase("field1", ("value1", "value3")), []),
        (Q.Term("s2", "aaaaaaaaa"), [2]),
        (Q.TermRange("s1", "b", "d"), [1, 2]),
        (Q.TermRange("s1"), []),
        (Q.Exists("day"), [1, 2, 3]),
        (Q.DateRange("day", datetime(2015, 1, 1), datetime(2015, 12, 31)), [1, 3]),
        (Q.DateRange("day", None, None), [4]),
        (Q.DateRange("day", datetime(2015, 5, 12), None, with_low=False), [3]),
        (Q.DateRange("day", datetime(2015, 1, 1), None, Resolution.MONTH), []),
        (Q.DateRange("sec", datetime(2014, 11, 22, 10, 2, 23), datetime(2015, 5, 12, 17, 15, 33), Resolution.SECOND, True, True, False), [2]),
        (Q.DateRange("sec", datetime(2014, 11, 22, 10, 2, 23), datetime(2015, 5, 12, 17, 15, 32), Resolution.SECOND, True, True, False, True), [1, 2]),
        (Q.Bool(((Q.MUST_NOT, Q.Term("id", "doc1")),)), []),
        (Q.Bool(((Q.MUST, Q.Term("field1", "value2")), (Q.MUST_NOT, Q.Term("id", "doc3")))), [2, 4]),
        (Q.MatchNone(), []),
    ],
)
def test_predicates(index, query, want):
    assert found(index, query) == want


def test_wildcard_needs_a_sign():
    with pytest.raises(ValueError):
        Q.Wildcard("f", "plain")
    assert glob_regex("a.b*c\\*?") == "(?s)^a\\.b.*c\\*.$"


@pytest.mark.parametrize("sorts, want", [(["s1"], [4, 2, 1, 3]), (["s2"], [2, 1, 4, 3]), (["-s2"], [3, 4, 1, 2]), (["s3"], [4, 1, 3, 2]), (["doc"], [1, 2, 3, 4]), (["-doc"], [4, 3, 2, 1])])
def test_sorts(index, sorts, want):
    assert [r.ord for r in se.top(index, index.df, sorts).collect()] == want


def test_pages_join_to_the_whole(index):
    pages = [r.ord for n in (1, 2, 3) for r in se.top(index, index.df, ["s1"], se.Page(n, 2)).collect()]
    assert pages == [4, 2, 1, 3]
    assert [se.Page(1, 20).count(n) for n in (0, 1, 20, 21)] == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        se.Page(0)


def test_scores(index):
    r = se.search(index, Q.Term("field1", "value3") | Q.Term("field1", "value1"))
    assert r.total() == 4 and not r.is_empty() and r.pages() == 1
    rows = r.page_df.collect()
    assert rows[0].ord == 3 and [x.score for x in rows] == sorted([x.score for x in rows], reverse=True)
    twice = se.bm25(index, Q.Boost(Q.Term("field1", "value1"), 2.0)).orderBy("ord").collect()
    once = se.bm25(index, Q.Term("field1", "value1")).orderBy("ord").collect()
    assert all(abs(a.score - 2 * b.score) < 1e-12 for a, b in zip(twice, once))


T = lambda t: Q.Term("field", t)


@pytest.mark.parametrize(
    "text, or_, want",
    [
        ("value", True, T("value")),
        ("value1 value2", True, T("value1") | T("value2")),
        ("value1 value2", False, T("value1") & T("value2")),
        ('"value1 value2"', True, Q.Phrase("field", ("value1", "value2"))),
        ("value1 AND value2", True, T("value1") & T("value2")),
        ("value1 OR value2", True, T("value1") | T("value2")),
        ("value1 AND (value2 OR value3)", True, T("value1") & (T("value2") | T("value3"))),
        ("value1 AND (value2 value3)", True, T("value1") & (T("value2") | T("value3"))),
        ("value1 OR (value2 AND value3)", True, T("value1") | (T("value2") & T("value3"))),
        ('"value1 AND value2"', True, Q.Phrase("field", ("value1", "AND", "value2"))),
        ("  ", True, None),
    ],
)
def test_words(text, or_, want):
    assert parse_words("field", text, WHITESPACE, or_) == want


def test_question(index):
    catalog = Catalog()
    for f in index.fields.values():
        catalog.register(f)
    q = Question({"field1": 2.0, "id": 1.0}, "value3 doc1", analyzer=STANDARD, catalog=catalog).query()
    assert found(index, q) == [1, 3]
    q = Question({"field1": 1.0}, "value2 value3", operators=True, default_or=False, analyzer=STANDARD).query()
    assert found(index, q) == [3]


@pytest.mark.parametrize("text, want", [("+field1:value2 -id:doc3", [2, 4]), ('field1:"value1 value2"', [2, 3, 4]), ("wildcard:(lion OR tiger)", [3, 4]), ("id:[doc2 TO doc4}", [2, 3]), ("wildcard:ele* AND NOT wildcard:tiger", [2]), ("wildcard:lino~1", []), ("wildcard:loin~", [3]), ("id:/doc[13]/", [1, 3]), ("s1:*", [1, 2, 3, 4]), ("field1:value3^4 wildcard:tiger", [3, 4])])
def test_predicate_syntax(index, text, want):
    assert found(index, parse_predicate(text)) == want


@pytest.mark.parametrize("text", ["word", "f:", "f:(a", "f:a)", "f:*a", "AND f:a", '"'])
def test_faults(text):
    with pytest.raises(SyntaxFault):
        parse_predicate(text)


def test_filters(index):
    keep = Q.string_filter("id", doc1=Q.MUST_NOT)
    assert found(index, keep.apply(Q.Term("field1", "value1"))) == [2, 3, 4]
    assert found(index, keep.apply(None)) == []
    assert found(index, Q.ValueFilter("field3", ((1, Q.SHOULD), (4, Q.SHOULD)), "int").apply(Q.Term("field1", "value1"))) == [1, 4]


def test_terms(index, spark):
    assert [r.term for r in te.values(index, "field1").collect()] == ["value1", "value2", "value3", "value4"]
    assert te.doc_freq(index, "field1", "value2").first()[0] == 3
    words = spark.createDataFrame([(1, "glove close clone"), (2, "glove pretense pretentious clvoe")], "ord int, t string")
    at = Index.of(words, "ord", Field("t"))
    assert {(r.term, r["count"]) for r in te.fuzzy(at, "t", "clove").collect()} == {("close", 1), ("clone", 1), ("glove", 2), ("clvoe", 1)}
    assert {r.term for r in te.fuzzy(at, "t", "clove", 1, swaps=True).collect()} == {"close", "clone", "glove", "clvoe"}
    assert {r.term for r in te.prefixed(at, "t", "preten").collect()} == {"pretense", "pretentious"}
    assert {r.term for r in te.prefixed(at, "t", "glove", exact=False).collect()} == set()
    assert te.distance_with_swaps("abcd", "acbd") == 1
    p = {(r.term, r.doc): (r.tf, r.positions, r.length) for r in at.postings(["t"]).collect()}
    assert p["glove", 1] == (1, [0], 3) and len(p) == 7


def test_suggestions(spark):
    rows = [(1, "electric scooter", "it's not a train!", ["green", "yellow"]), (2, "electric train", "", ["blue"]), (3, "electric train", "", ["yellow"]), (4, "acoustic guitar", "", ["green"]), (5, "electric guitar", "", ["red", "blue"]), (6, "action figure guerilla", "", ["green", "gold"])]
    index = Index.of(spark.createDataFrame(rows, "ord int, name string, description string, color array<string>"), "ord", Field("name"), Field("description", analyzer=UNICODE), Field("color", "keyword", multi=True))
    ask = lambda *w, **k: [r.ord for r in su.suggestion_predicate(index, w, **k).orderBy("ord").collect()]
    n = lambda p: ("name", p)
    assert ask(n("elec")) == [1, 2, 3, 5]
    assert ask(n("elec"), condition=Q.Term("color", "blue")) == [2, 5]
    assert ask(n("elec"), n("gui")) == [1, 2, 3, 4, 5]
    assert ask(n("elec"), n("gui"), union=False) == [5]
    assert ask(n("ac"), n("gu"), union=False) == [4, 6]
    assert ask(n("ac"), n("invalid"), union=False) == [4, 6]
    assert ask(n("invalid"), union=False) == []
    assert ask(n("elec"), n("tra"), ("description", "elec"), ("description", "tra"), union=False) == [1, 2, 3]
    query, short = su.suggestion_query(index, [n("elec")])
    assert found_ords(index, query) == [1, 2, 3, 5] and not short
    how = su.AutoSuggest(("name",), criteria="color")
    built = how.build(index)
    assert [r.text for r in how.suggest(built, "elec", ["yellow"]).collect()] == ["electric scooter", "electric train"]
    assert how.suggest(built, "electric gu").first().highlight == "<b>electric</b> <b>gu</b>itar"
    assert how.suggest(built, "e").count() == 0
    assert {r.ord for r in su.similar_documents(index, 2, ["name"]).collect()} >= {1, 3, 5}


def found_ords(index, query):
    return [r.ord for r in se.matches(index, query).orderBy("ord").collect()]


def test_weights(spark):
    df = spark.createDataFrame([(1, None, None), (2, "0.5", "2"), (3, "10", "0.25"), (4, "3", None)], "k int, w1 string, w2 string")
    get = lambda **w: sorted((r[0] for r in df.select(su.weight(df, w)).collect()), reverse=True)
    assert get(w1=1.0) == [1000, 300, 100, 50]
    assert get(w1=0.5, w2=10.0) == [2025, 1150, 1050, 750]
    assert get(w1=0.0, w2=4.0) == [800, 400, 400, 100]
    assert su.parse_weights("a:2,b,c:x") == {"a": 2.0, "b": 1.0}


def test_union(index):
    both = union(index, index)
    assert se.count(both, Q.Term("field1", "value1")).first()[0] == 8
