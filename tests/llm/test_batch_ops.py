"""Operators on texts against brute force: BPE, token counts, fingerprints, language, toxicity."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import bpe, fingerprint, langid, mixing, toxicity
from sievelight.llm.text import utf8

ODD = ["", None, "word", " a  b\n\n", "x" * 5000, "don't we'll 3.14 naïve ßü 漢字 😀", "a b " * 3000, "word", "\x00　\t"]


def frame(spark, texts=ODD, extra=True):
    rows = [(i if i % 5 else None if i else 0, t, "en", "s", 1, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k int")
    return df.withColumnsRenamed({"lang": "N_Tokens"}) if extra else df


def test_bpe_is_the_plain_merge(spark):
    import tiktoken

    ranks = bpe.vocabulary()
    out = bpe.round_trip(frame(spark)).orderBy("k").collect()
    assert all(r.round_trip for r in out)
    table = {}
    import base64

    for line in open(bpe.RANKS, "rb"):
        token, rank = line.split()
        table[base64.b64decode(token)] = int(rank)
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    for r, t in zip(out, ODD):
        assert list(r.token_ids or []) == plain.encode_ordinary(t or "") and r.n_tokens == len(r.token_ids or [])
    counts = bpe.token_counts(frame(spark)).orderBy("k").collect()
    assert [r.n_tokens for r in counts] == [r.n_tokens for r in out]
    assert bpe.token_counts(frame(spark).limit(0)).count() == 0 and ranks is not None
    assert bpe.decode(bpe.encode(frame(spark))).count() == len(ODD)


def naive_features(texts, rank, entropy):
    want = []
    for d, t in enumerate(texts):
        n = len((t or "").encode()) - 63
        named = Counter()
        for s in range(-63, n):
            inside = [(rank[entropy[d, i]], i) for i in range(max(0, s), min(n, s + 64))]
            if inside and min(inside)[0] < fingerprint._NONE:
                named[min(inside)[1]] += 1
        want += [(d, i) for i in sorted(named) if named[i] >= fingerprint.POPULAR]
    return want


def test_fingerprint_features(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", None, "short", "a" * 300] + ["".join(rng.choice(list("abcdefgh éß"), int(n))) for n in (64, 63, 65, 200, 900, 130, 127, 128)]
    entropy, total = {}, np.zeros(1001, int)
    for d, t in enumerate(texts):
        b = (t or "").encode()
        for i in range(len(b) - 63):
            c = Counter(b[i : i + 64])
            entropy[d, i] = (fingerprint._FULL - sum(int(fingerprint._GAIN[k]) for v in c.values() for k in range(v))) * 1000 // fingerprint._FULL
            assert abs(entropy[d, i] + sum(v / 64 * math.log2(v / 64) for v in c.values()) / 6 * 1000) <= 1.01
            total[entropy[d, i]] += 1
    rank = fingerprint.ranks_of(total)
    column = pa.array(texts, pa.string())
    raw, off = utf8(column)
    for segment in (100, 1 << 18):
        monkeypatch.setattr(fingerprint, "_SEGMENT", segment)
        assert (fingerprint.entropy_counts(column) == total).all()
        doc, start = fingerprint.features(raw, off, rank)
        assert list(zip(doc.tolist(), (start - off[doc]).tolist())) == naive_features(texts, rank, entropy)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert (fingerprint.rarity(df) == rank).all() and (fingerprint.rarity(df.limit(0)) == fingerprint.ranks_of(np.zeros(1001, int))).all()
    got = fingerprint.digests(df, rank).orderBy("doc_id").collect()
    # Every digest as if its text stood alone
    for r, t in zip(got, texts):
        count, chain, filters = fingerprint.digest_column(pa.array([t], pa.string()), rank)
        assert (r.n_features, bytes(r.digest)) == (count[0], filters.tobytes()) and len(r.digest) == 256 * chain[0]


def test_fingerprint_scores(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, other = text(2500), text(2500)
    texts = [base, base, base[:4000] + other[:4000], other, base[3000:7000], "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, SCORE string")
    rank = fingerprint.rarity(df)
    d = fingerprint.digests(df, rank)
    rows = {r.doc_id: (r.n_features, bytes(r.digest)) for r in d.collect()}
    score = lambda i, j: fingerprint.compare(*rows[i], *rows[j])
    assert score(0, 1) == 100 and score(0, 3) < 5 and score(4, 0) > 50 and score(0, 5) == 0
    assert all(abs(score(i, j) - score(j, i)) < 1e-6 for i in rows for j in rows)
    for size in (1 << 20, 1000):  # the latter in several turns
        monkeypatch.setattr(fingerprint, "KNOWN_BYTES", size)
        known = d.where("doc_id in (0, 3, 4)").withColumnRenamed("doc_id", "item_id").drop("SCORE")
        got = {r.doc_id: (r.match_id, r.score) for r in fingerprint.match(d, known).collect()}
        for i in rows:
            best = max(((round(score(i, k), 3), -k) for k in (0, 3, 4)))
            assert got[i] == ((-best[1], pytest.approx(best[0], abs=2e-3)) if best[0] > 0 else (None, 0.0))


LANGS = {"aa": "lorem dolor amet", "bb": "zwischen wasser kirche", "cc": "ñandu queso mañana"}


def labelled(n=60):
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(LANGS[k].split()) for _ in range(40)), k) for i, k in enumerate(list(LANGS) * n)]


def naive_score(word, p, lat):
    """All segmentations one by one."""
    if not word:
        return 1.0
    total = naive_score(word[1:], p, lat) * langid._UNKNOWN
    for n in range(1, len(word) + 1):
        if word[:n] in lat:
            total += p[lat[word[:n]]] * naive_score(word[n:], p, lat)
    return total


def test_language(spark):
    df = spark.createDataFrame(labelled(), "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert model["langs"] == sorted(LANGS)
    lat = langid.lattice()
    ids = {p: i for i, p in enumerate(lat.pieces)}
    words = langid.words_of(pa.array(["dolor queso x"]), langid._MARK)
    got = langid.word_scores(words, model["p"], lat)
    for k in range(3):
        for w in range(len(words.key)):
            text = "".join(map(chr, words.cp[words.off[w] : words.off[w + 1]]))
            assert got[w, k] == pytest.approx(math.log(naive_score(text, model["p"][:, k], ids)), rel=1e-9)
    tests = [(1, "amet lorem dolor", "aa"), (2, "kirche wasser", "bb"), (3, None, None), (4, "", None), (5, "123 456", None), (6, "xqj zzkv wrpt " * 50, None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(a, b) for a, b, _ in tests], "doc_id bigint, text string"), model).collect()}
    assert [out[i].language for i, _, _ in tests] == [x for _, _, x in tests]
    none = langid.train(df.limit(0))
    assert langid.identify(df, none).where("language is not null").count() == 0 and langid.identify(df.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abdefgilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                t.insert(rng.randrange(60), rng.choice(["stinkhead", "dumbface", "jerkish"]))
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 600] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    held = [(r[2], got[r[0]].is_toxic) for r in rows if r[0] >= 600]
    assert sum(a and b for a, b in held) >= 90 and sum(b and not a for a, b in held) <= 4
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "so stinkheed dumbfaces you jerkishh")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in toxicity.classify(odd, model).collect()}
    assert [out[i].score for i in (1, 2, 3)] == [0, 0, 0] and out[4].is_toxic
    bare = toxicity.train(df, labels.limit(0))
    assert toxicity.classify(df, bare).where("is_toxic or score > 0").count() == 0 and toxicity.classify(df.limit(0), model).count() == 0


def test_mixing(spark):
    rows = [(i if i else None, f"s{i % 3}" if i % 7 else None, i % 50 if i % 11 else None, "x") for i in range(500)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id bigint, source string, n_chars bigint, bucket string")
    weights = {"s0": 100, "s1": 0}
    out = mixing.mix(df, weights, 50, copy="copy")
    got = Counter((r.doc_id, r.source, r.n_chars) for r in out.collect())
    assert out.columns == [*df.columns, "copy"] and not any(k[1] == "s1" for k in got)
    chars, expected = Counter(), {}
    for _, s, n, _ in rows + rows[:5]:
        chars[s or ""] += n or 0
    for d, s, n, _ in rows:
        w = weights.get(s or "", 50)
        total = sum(weights.get(x or "", 50) for x in chars)
        size = sum(chars[x] for x in chars if weights.get(x, 50))
        expected[d, s, n] = w / total * size / chars[s or ""] if w else 0
    once = Counter((r[0], r[1], r[2]) for r in rows + rows[:5])
    for k, n in once.items():
        assert n * math.floor(expected[k]) <= got[k] <= n * math.ceil(expected[k] + 1e-9), (k, expected[k], got[k])
    assert mixing.mix(df.limit(0)).count() == 0
