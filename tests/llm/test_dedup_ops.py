"""Searches for likenesses against brute force."""

import random
import re

import numpy as np
import pytest

from sievelight.llm import embeddings, linededup, simhash, substring
from sievelight.llm.graph import components

_letters = random.Random(0)
WORDS = ["".join(_letters.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def forest(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).where("node <> root").collect()}
    assert got == {k: v for k, v in forest(pairs).items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("interval, block", [(8192, 512), (60, 16)])
def test_embeddings(spark, monkeypatch, interval, block):
    monkeypatch.setattr(embeddings, "INTERVAL", interval)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    x[200:260] = x[:60] + rng.normal(size=(60, 24)) * 0.15  # about the threshold
    x[260:300] = x[7] * np.linspace(1, 3, 40)[:, None]
    x[300:340] = x[9] + rng.normal(size=(40, 24)) * 0.02
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= embeddings.COSINE, 1))
    odd = [(900, None, "e"), (901, [], "e"), (902, [0.0] * 24, "e"), (903, [float("nan")] * 24, "e"), (None, rows[0][1], "e"), (905, rows[3][1], "e"), (905, rows[3][1], "e"), (906, [1.0], "e"), (907, [2.0, None], "e")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, keep_id string")
    got = {r.vec_id: r.keep_id for r in embeddings.groups(df).collect()}
    want = forest([*zip(i.tolist(), j.tolist()), (3, 905), (906, 907)])
    assert got == want
    kept = embeddings.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + len(odd) - len(want) - 1
    assert embeddings.groups(df.limit(0)).count() == 0


def test_simhash(spark):
    rng = random.Random(3)
    docs = [sentence(rng, 120) for _ in range(120)]
    near, want = [], {}
    for k in range(40):
        words = docs[k].split()
        for p in rng.sample(range(120), 3):
            words[p] = rng.choice(WORDS)
        near.append(" ".join(words))
        want[1000 + k] = k
    rows = [(i, t, 1) for i, t in enumerate(docs)] + [(1000 + k, t, 1) for k, t in enumerate(near)]
    rows += [(2000, "", 1), (2001, None, 1), (2002, "...", 1), (2003, "...", 1), (None, docs[0], 1), (3000, docs[50].upper(), 1), (3000, docs[50], 1), (4000, sentence(rng, 30000), 1)]
    want |= {2001: 2000, 2003: 2002, 3000: 50}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sig int")
    got = {r.doc_id: r.keep_id for r in simhash.groups(df).collect()}
    assert not set(got) - set(want) and len(got) >= 0.9 * len(want) and all(want[k] == v for k, v in got.items())
    # All pairs of signatures
    signed = [(r.id, np.unpackbits(np.frombuffer(r.sig, np.uint8)), r.words) for r in simhash.signatures(df).collect()]
    close = [(a, b) for a, s, m in signed for b, t, n in signed if a < b and (s != t).sum() <= simhash.DISTANCE and 2 * min(m, n) >= max(m, n)]
    whole = forest(close)
    assert sum(got.get(k) == v for k, v in whole.items()) >= 0.9 * len(whole)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(got)
    assert simhash.groups(df.limit(0)).count() == 0


def words_of(line):
    return frozenset(re.findall(r"[0-9a-z]+|[^\x00-\x7f]+", line.lower()))


def test_lines(spark):
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(1, 12)) for _ in range(80)]
    docs = {}
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(base).split()
            if len(words) > 3 and rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        docs[d] = "\n".join(lines)
    docs |= {100: "", 101: None, 102: "\n\n...\n", 103: sentence(rng, 20000), 104: docs[3]}
    df = spark.createDataFrame([(k, t, len(t or ""), 1) for k, t in docs.items()] + [(None, docs[1], 1, 1)], "doc_id bigint, text string, n_chars bigint, line int")
    lines = [(d, n, words_of(x)) for d, t in sorted(docs.items()) for n, x in enumerate((t or "").split("\n")) if words_of(x)]
    want = set()
    for i, (d, n, s) in enumerate(lines):
        if any(len(s & r) / len(s | r) >= linededup.THRESHOLD - 1e-9 for _, _, r in lines[:i]):
            want.add((d, n))
    got = linededup.removed(df).collect()
    assert {(r.doc_id, r.line) for r in got} == want and len(got) == len(want)
    place = {(d, n): s for d, n, s in lines}
    for r in got:
        a, b = place[r.doc_id, r.line], place[r.match_id, r.match_line]
        assert (r.match_id, r.match_line) < (r.doc_id, r.line) and len(a & b) / len(a | b) >= linededup.THRESHOLD - 1e-9
    kept = {r.doc_id: r for r in linededup.deduplicate(df).collect()}
    for d, t in docs.items():
        left = [x for n, x in enumerate((t or "").split("\n")) if (d, n) not in want]
        lost = any(k == d for k, _ in want)
        if lost and not any(words_of(x) for x in left):
            assert d not in kept
        else:
            assert kept[d].text == ("\n".join(left) if lost else t) and kept[d].n_chars == len(kept[d].text or "")
    assert linededup.removed(df.limit(0)).count() == 0 and None in kept


def test_substrings(spark):
    rng = random.Random(6)
    passages = [sentence(rng, n) for n in (50, 49, 80, 300)]
    docs = {i: " ".join([sentence(rng, rng.randint(5, 90)), *([passages[i % 4]] if i % 3 else []), sentence(rng, rng.randint(5, 40))]) for i in range(40)}
    docs |= {50: "", 51: None, 52: docs[5], 53: passages[2] + " " + passages[2]}
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(None, docs[3], 1)], "doc_id bigint, text string, start int")
    least = substring.LEAST
    seen, covered = {}, {}
    for d in sorted(docs):
        w = (docs[d] or "").split()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        for i, g in enumerate(grams):
            if seen.get(g, d) != d:
                covered.setdefault(d, set()).update(range(i, i + least))
        for g in grams:
            seen.setdefault(g, d)
    got = {}
    rows = substring.spans(df).collect()
    names = [c for c in rows[0].asDict() if c != "doc_id"]
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(covered), names
    kept = {r.doc_id: r.text for r in substring.deduplicate(df).collect()}
    assert kept[50] == "" and kept[51] is None
    for d, place in covered.items():
        left = [x for i, x in enumerate(docs[d].split()) if i not in place]
        assert (kept.get(d) or "").split() == left
    assert substring.spans(df.limit(0)).count() == 0
