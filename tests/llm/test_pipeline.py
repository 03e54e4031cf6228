"""The pipeline and its stages against plain versions on a small table."""

import random

import corpus_pipeline as p
import numpy as np
import pytest

from sievelight.llm import langid, simhash

from . import brute

LANGS = {"aa": "lorem dolor amet consec tetur adipis cing elit sed do eius mod tempor", "bb": "zwischen wasser kirche strasse und der garten morgen abend nicht", "cc": "ñandu queso mañana perro gato ventana camino sol luna"}


def documents():
    rng = random.Random(8)
    line = lambda k: " ".join(rng.choice(LANGS[k].split()) + rng.choice(["", "", "en", "a", "or"]) for _ in range(rng.randint(6, 14)))
    rows = []
    for i in range(90):
        k = list(LANGS)[i % 3]
        rows.append([i * 7, "\n".join(line(k) for _ in range(rng.randint(1, 5))), k, f"src{i % 5}"])
    rows[20][1] = rows[5][1]  # an exact copy
    rows[41][1] = rows[40][1].replace("a ", "e ", 1)
    rows[42][1] = "xqjz kkvw qqqq zzkv wrpt 77x " * 9  # no language
    rows[43][1] = "zwischen wasser"
    near = rows[60][1].replace("\n", " ").split()
    rows[61][1:3] = [" ".join([*near[1:], near[0], "garten"]), rows[60][2]]
    rows[60][1] = " ".join(near)
    rows[70][1], rows[71][1], rows[72][3], rows[73][2] = "", None, None, None
    return [(d, t, k, s, len(t) if t is not None else None) for d, t, k, s in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_run(spark, rows):
    """What run() gives for rows with distinct ids: {(doc_id, source, token ids): how often}."""
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    kept = {r[0]: r for r in rows if brute.language(r[1], model)}
    texts = brute.without_lines({d: r[1] for d, r in kept.items()})
    after = [(d, t, kept[d][2], kept[d][3], len(t)) for d, t in texts.items()]
    gone = brute.near_groups([(r.id, bytes(r.sig), r.words) for r in simhash.signatures(spark.createDataFrame(after, SCHEMA)).collect()])
    left = [r for r in after if r[0] not in gone]
    copies = brute.mixture([(r[0], r[3], r[4]) for r in left])
    coder = brute.plain_bpe()
    return {(r[0], r[3], tuple(coder.encode_ordinary(r[1]))): copies[r[0]] for r in left if r[0] in copies}, (len(kept), len(after), len(left))


def test_run_is_the_plain_version(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes = plain_run(spark, rows)
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > 0  # every stage has something to do
    got = {}
    for r in p.run(spark, str(tmp_path)).collect():
        assert r.round_trip and r.n_tokens == len(r.token_ids)
        key = r.doc_id, r.source, tuple(r.token_ids)
        got[key] = got.get(key, 0) + 1
    assert got == want


CLASH = "row string, id string, gone string, at string, cuts string, language string, score string, lead string, copies string, bucket string, N_Tokens string, __text string, __gone string, x string"


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_stages_at_the_edges(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows, clashing names and an empty table."""
    rng = np.random.default_rng(3)
    long = " ".join(a + b for a, b in rng.choice(LANGS["bb"].split(), (60_000, 2))) + " " + "zwischen" * 2_500
    base = [(i, "\n".join(" ".join(rng.choice(LANGS[k].split(), 9)) for _ in range(3)), k, "src1", 200) for i, k in enumerate(list(LANGS) * 12)]
    odd = [(100, None, None, None, None), (None, None, None, None, None), (None, base[0][1], "aa", "src2", -5), (101, "", "bb", "", 0), (102, long, "bb", "src1", len(long)), (103, "\n\n... \n", "cc", "src3", 8), base[1], base[1], (104, base[2][1], "cc", "src1", 200)]
    rows = base + odd
    fill = tuple("kept" for _ in CLASH.split(","))
    df = spark.createDataFrame([r + fill for r in rows], f"{SCHEMA}, {CLASH}")
    out = stage(spark, df, "")
    got = out.collect()
    assert stage(spark, df.limit(0), "").count() == 0
    if name == "bpe":
        assert len(got) == len(rows) and all(r.round_trip for r in got)
        return
    assert out.columns == df.columns and all(v == "kept" for r in got for v in r[5:])
    ids = [r.doc_id for r in got]
    if name == "language_id":
        assert {100, 101, 103}.isdisjoint(ids) and ids.count(1) == 3 and {102, 104} <= set(ids) and None in ids
    elif name == "line_dedup":
        # The copy 104 has no lines of its own; rows of one id never lose lines to each other
        assert ids.count(1) == 3 and 104 not in ids and ids.count(None) == 2 and {100, 101, 103} <= set(ids)
        assert next(r for r in got if r.doc_id == 102).text == long
    elif name == "simhash_near_dedup":
        # Null and empty text are alike, so the later one goes
        assert ids.count(1) == 3 and 104 not in ids and 101 not in ids and ids.count(None) == 2 and 102 in ids
    else:
        assert set(ids) <= {r[0] for r in rows} and len(got) > 0


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()
