"""The registered fingerprint queries on small tables of their own."""

import random

import pytest

from sievelight.llm import fingerprint, queries

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuvw") for _ in range(RNG.randint(2, 9))) for _ in range(600)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ITEMS = [text(n) for n in [11, 12, 13, 15, 17, 20, 25, 30, 45, 60]]


def tables(spark, path, docs, items):
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_item_is_found_where_it_stands_verbatim(spark, tmp_path):
    docs = [f"{text(a)} {item} {text(200 - a)}" for a in (3, 90) for item in ITEMS] + [text(200) for _ in range(10)]
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, tables(spark, tmp_path, docs, [*ITEMS, None, "", "short"])).collect()}
    assert len(got) == len(docs)
    for d in range(20):
        assert got[d].match_id == d % 10 and got[d].score > 10, (d, got[d].match_id, got[d].score)


def test_every_item_of_a_document_is_listed(spark, tmp_path, monkeypatch):
    docs = [f"{text(150)} {ITEMS[8]} {text(150)} {ITEMS[3]} {text(40)} {ITEMS[6]} {text(90)}", f"{ITEMS[9]} {text(50)}", text(300), None, ""]
    path = tables(spark, tmp_path, docs, ITEMS)
    for size in (1 << 20, 600):  # the latter in several turns
        monkeypatch.setattr(fingerprint, "KNOWN_BYTES", size)
        got = {r.doc_id: r for r in queries.op3_fingerprints(spark, path).collect()}
        assert [sorted(m.id for m in got[d].matches) for d in range(5)] == [[3, 6, 8], [9], [], [], []]
        for r in got.values():
            order = [(-m.score, m.id) for m in r.matches]
            assert order == sorted(order) and all(m.score >= fingerprint.THRESHOLD for m in r.matches)
            assert not order or (r.match_id, r.score) == (r.matches[0].id, r.matches[0].score)


def test_documents_are_compared_with_each_other(spark, tmp_path):
    base = [text(300) for _ in range(12)]
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(base[0].split()))
    docs = [*base, base[1], base[1], near, f"{base[2]} {text(300)}", f"{text(100)} {base[3][:900]} {text(60)}", "", None, base[4] + " " + base[5], ITEMS[0], ITEMS[0]]
    path = tables(spark, tmp_path, docs, ITEMS)
    got = {(r.a, r.b): r.score for r in queries.op3_fingerprint_pairs(spark, path).collect()}
    rank = fingerprint.rarity(queries.read(spark, path, "documents"), window=32)
    made = {r.doc_id: (r.n_features, bytes(r.digest)) for r in fingerprint.digests(queries.read(spark, path, "documents"), rank, grain=fingerprint.FINE).collect()}
    heads, want = {}, {}
    for i, d in sorted(made.items()):
        if d[0] and heads.setdefault(d, i) != i:
            want[heads[d], i] = 100
    for a in heads.values():
        for b in heads.values():
            if a < b and (s := round(fingerprint.contained(*made[a], *made[b]), 3)) >= fingerprint.THRESHOLD:
                want[a, b] = s
    assert set(want) >= {(1, 12), (1, 13), (0, 14), (2, 15), (3, 16), (4, 19), (5, 19), (20, 21)}
    assert got == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("n", [1, 2])
def test_filters_of_few_features_score_by_all_their_bits(n):
    import numpy as np

    few, many = np.zeros((1, 256), np.uint8), np.full((1, 256), 255, np.uint8)
    few[0, : 5 * n] = 1
    none = np.zeros((1, 256), np.uint8)
    assert fingerprint.overlap_scores(few, np.array([n]), np.vstack([many, few, none]), np.array([160, n, 0])).tolist() == [[100, 100, 0]]
