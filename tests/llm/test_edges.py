"""Every operator at its edges: sizes that once lost results, clashing names, ids of any kind."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import bpe, embeddings, exchange, fingerprint, langid, linededup, mixing, simhash, substring, toxicity
from sievelight.llm.graph import cut
from sievelight.llm.words import words_of

from . import brute

_letters = random.Random(0)
WORDS = ["".join(_letters.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
CLASH = "row string, id string, gone string, at string, cuts string, keep_id string, line string, src string, tie string, vec string, sig string, words string, __text string, `a b` string"
FILL = tuple("kept" for _ in CLASH.split(","))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ------------------------------------------------------------------ line dedup


def test_a_text_of_millions_of_lines_loses_no_match():
    """Beyond 2**22 lines in one text; only the keys are looked at, as the plan is the same."""
    n = (1 << 22) + 10
    column = pa.array(["a\n" * n + "the quick brown fox\nover a lazy dog\n", "the quick brown fox"])
    row, number, first, word = linededup.line_words(column, lambda w: (w & np.uint64(7)).astype(np.int64))
    assert len(row) == n + 3 and number[n] == n and number[n + 1] == n + 1 and row[-1] == 1
    at = first[n], first[n + 1], first[-2], first[-1]
    assert (word[at[0] : at[1]] == word[at[2] : at[3]]).all() and len(word[at[0] : at[1]]) == 4


def test_lines_name_the_first_match(spark, monkeypatch):
    rng = random.Random(5)
    base = [sentence(rng, 8) for _ in range(12)]
    docs = {}
    for d in range(40):
        lines = [rng.choice(base).split() for _ in range(4)]
        for words in lines:
            if rng.random() < 0.5:
                words[rng.randrange(8)] = rng.choice(WORDS[:3])
        docs[d] = "\n".join(" ".join(w) for w in lines)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    want = brute.matches(docs)
    for limit in (exchange.GATHERED, 200):  # the latter in many rows
        monkeypatch.setattr(exchange.Packer.__init__, "__defaults__", (0, limit))
        assert {(r.doc_id, r.line): (r.match_id, r.match_line) for r in linededup.removed(df).collect()} == want


def test_lines_of_documents_without_a_size_and_with_clashing_names(spark):
    rows = [("1", "alpha beta gamma delta\nown line here", *FILL), ("2", "alpha beta gamma delta", *FILL), ("x", "alpha beta gamma delta", *FILL), (None, "alpha beta gamma delta", *FILL)]
    df = spark.createDataFrame(rows, f"doc_id string, text string, {CLASH}")
    got = linededup.deduplicate(df)
    assert got.columns == df.columns and sorted((r.doc_id or "", r.text) for r in got.collect()) == [("", rows[3][1]), ("1", rows[0][1]), ("x", rows[2][1])]
    assert all(r[2:] == FILL for r in got.collect()) and linededup.deduplicate(df.limit(0)).count() == 0


# ------------------------------------------------------------------ simhash


def test_dense_nodes_link_as_all_pairs_do():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 256, (3, 32), np.uint8)
    rows = []
    for k, n in enumerate((900, 500, 40)):
        flips = np.packbits(rng.random((n, 256)) < 0.09, axis=1)
        rows.append(centre[k] ^ flips)
    far = np.packbits(rng.random((60, 256)) < 0.13, axis=1) ^ centre[0]
    sig = np.concatenate([*rows, far])
    words = np.full(len(sig), 100, np.int32)
    bits = np.unpackbits(sig, axis=1).astype(np.int64)
    distance = bits @ (1 - bits).T + (1 - bits) @ bits.T
    i, j = np.nonzero(np.triu(distance <= simhash.DISTANCE, 1))
    want = brute.forest(list(zip(i.tolist(), j.tolist())))
    # One node of all: depth 0
    a, b = simhash.node_links(sig, words, simhash.trie_keys(sig, 0), 0, 0, simhash.DISTANCE)
    assert brute.forest(list(zip(a.tolist(), b.tolist()))) == want and len(a) < len(sig)


def test_the_recall_is_measured(spark):
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 256, (600, 32), np.uint8)
    flips = np.zeros((300, 256), np.uint8)
    for r in flips:
        r[rng.choice(256, 44, False)] = 1
    sig[300:] = sig[:300] ^ np.packbits(flips, axis=1)
    df = spark.createDataFrame([(i, bytes(s.tobytes()), 50) for i, s in enumerate(sig)], "id bigint, sig binary, words int")
    tries, deepest = 8, 40
    pairs, upto = simhash.measured(df, tries, deepest, 44)
    assert 0 < pairs <= 2 * simhash.SAMPLE and upto[0] == pairs and (np.diff(upto) <= 0).all() and upto[40] < pairs
    tries, depth, recall = simhash.climb(df, 600)
    assert recall >= simhash.RECALL and depth >= 0
    # Against the share that meets among all pairs
    meet = [max(int((simhash.trie_keys(sig[i : i + 1], t) >> np.uint64(64 - depth))[0] == (simhash.trie_keys(sig[i + 300 : i + 301], t) >> np.uint64(64 - depth))[0]) for t in range(tries)) if depth else 1 for i in range(300)]
    assert np.mean(meet) >= 0.9
    assert simhash.climb(df.limit(0), 0)[2] is None


def test_parts_that_are_dense_go_by_nodes(spark, monkeypatch):
    rng = random.Random(9)
    texts = [sentence(rng, 100) for _ in range(50)]
    for _ in range(8):
        base = sentence(rng, 150).split()
        for _ in range(20):
            words = list(base)
            for p in rng.sample(range(150), 2):
                words[p] = rng.choice(WORDS)
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute.near_groups([(r.id, bytes(r.sig), r.words) for r in simhash.signatures(df).collect()])
    monkeypatch.setattr(simhash, "_BUCKET", 1)
    got = {r.doc_id: r.keep_id for r in simhash.groups(df).collect()}
    assert len(want) > 120 and sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want) and set(got) <= set(want)


def test_near_dedup_with_ids_that_are_no_numbers_and_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("1", text, *FILL), ("2", text, *FILL), ("x", text, *FILL), (None, text, *FILL)]
    df = spark.createDataFrame(rows, f"doc_id string, text string, {CLASH}")
    got = simhash.deduplicate(df)
    assert got.columns == df.columns and sorted(r.doc_id or "" for r in got.collect()) == ["", "1", "x"] and all(r[2:] == FILL for r in got.collect())


# ------------------------------------------------------------------ substrings


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 5000, np.uint64)
    grams[1000:1400] = grams[2000:2400]
    grams[3000:3300] = 7
    key = grams >> np.uint64(24)
    want = [i + int(np.argmin(key[i : i + 26])) for i in range(5000 - 25)]
    for stretch in (1 << 22, 333, 1):
        monkeypatch.setattr(substring, "STRETCH", stretch)
        assert substring.anchors_of(grams, 26).tolist() == want
    assert len(substring.anchors_of(grams[:25], 26)) == 0


def test_spans_of_long_texts_in_many_rows(spark, monkeypatch):
    rng = random.Random(2)
    shared = sentence(rng, 120)
    docs = [(i, " ".join([sentence(rng, 400), shared if i % 2 else "", sentence(rng, 300)]), *FILL) for i in range(12)] + [(90, sentence(rng, 30_000) + " " + shared + " " + sentence(rng, 9), *FILL), (None, shared, *FILL)]
    df = spark.createDataFrame(docs, f"doc_id bigint, text string, {CLASH}")
    want = {(d, len(t.split()[: t.split().index(shared.split()[0])])) for d, t, *_ in docs if d is not None and shared in t and d > 1}
    for stretch, gathered in ((1 << 22, 32 << 20), (64, 1000)):
        monkeypatch.setattr(substring, "STRETCH", stretch)
        monkeypatch.setattr(substring, "GATHERED", gathered)
        got = substring.spans(df).collect()
        assert {r.doc_id for r in got} == {d for d, _ in want} and all(r.end_word - r.start_word >= 120 and r.ref_id < r.doc_id for r in got)
    kept = substring.deduplicate(df)
    assert kept.columns == df.columns and all(r[2:] == FILL for r in kept.collect())


# ------------------------------------------------------------------ embeddings


def test_embeddings_of_a_falling_spectrum_skip_most_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * 0.7 ** np.arange(24)
    x[2500:] = x[:500] * rng.uniform(0.5, 2, (500, 1)) + rng.normal(size=(500, 24)) * 0.002
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = 0.9995
    i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embeddings, "INTERVAL", 100)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    got = {r.vec_id: r.keep_id for r in embeddings.groups(df, cosine=cosine).collect()}
    assert got == brute.forest(list(zip(i.tolist(), j.tolist()))) and len(got) >= 450
    # Boxes of grid-ordered intervals rule out most of the pairs
    vectors = cut(embeddings.units(df, "vec_id", "embedding", 24))
    axis = embeddings.principal_axes(vectors, 24)
    y = unit @ axis
    order = np.argsort(embeddings.grid_keys(y.astype(np.float32), math.sqrt(2 - 2 * cosine)), kind="stable")
    boxes = [(y[order[k : k + 100], :16].min(0), y[order[k : k + 100], :16].max(0)) for k in range(0, 3000, 100)]
    near = sum(embeddings.gap_squares(*boxes[a], *boxes[b]) <= 2 - 2 * cosine + 1e-4 for a in range(30) for b in range(a, 30))
    assert near < 0.5 * 30 * 31 / 2


# ------------------------------------------------------------------ mixing


@pytest.mark.parametrize("few", [mixing.FEW, 3])
def test_mixing_of_ids_of_any_spread(spark, few):
    rng = random.Random(1)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [2**60, -(2**63), 2**63 - 1]
    rows = [(d, "hot" if k % 3 == 0 else f"s{k % 40}" if k % 7 else None, rng.randrange(500)) for k, d in enumerate(ids)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, source string, n_chars bigint, rate string, bits string")
    got = {}
    for r in mixing.mix(df, copy="copy", few=few).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == brute.mixture(rows)
    words = df.selectExpr("concat('id-', doc_id) as doc_id", "source", "n_chars")
    assert abs(mixing.mix(words).count() - len(rows)) < 60


def test_buckets_of_a_hot_source_are_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(d, "hot", 10) for d in [*range(1, 512), 2**60]]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint")
    plan = mixing.mix(df, {"hot": 100}, copy="copy")
    assert plan.count() == 512
    sizes = df.select(mixing._place(df.doc_id.cast("string")).alias("at")).selectExpr(f"shiftright(at, {mixing.BITS} - 5) as b").groupBy("b").count().collect()
    assert len(sizes) == 32 and max(r["count"] for r in sizes) < 64


# ------------------------------------------------------------------ language


def test_words_of_any_length_have_all_their_segmentations():
    rng = random.Random(4)
    lat = langid.lattice()
    p = np.random.default_rng(1).random((lat.none + 1, 2))
    p[lat.none] = 0
    p /= p.sum(0)
    ids = {x: i for i, x in enumerate(lat.pieces)}
    texts = ["the naïve word", "a" * 300, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "漢字" * 90 + "日本語のテキスト" * 30, "ﬀ" * 100]
    w = words_of(pa.array(texts), langid._MARK)
    got, counts = langid.word_scores(w, p, lat, np.ones((len(w.off) - 1, 2)))
    for i in range(len(w.off) - 1):
        word = "".join(map(chr, w.cp[w.off[i] : w.off[i + 1]]))
        for k in range(2):
            assert got[i, k] == pytest.approx(brute.log_likelihood(word, p[:, k], ids, lat.longest), rel=1e-9)
    # An expected count is the derivative of the log-likelihood by that of the probability
    for i in np.flatnonzero(counts[:, 0] > 0.5)[:5]:
        q = p.copy()
        q[i, 0] *= 1 + 1e-6
        assert (langid.word_scores(w, q, lat)[:, 0].sum() - got[:, 0].sum()) / 1e-6 == pytest.approx(counts[i, 0], rel=1e-3)


def test_language_of_repeated_rows_and_clashing_names(spark):
    rows = [(k % 4, {"aa": "lorem dolor amet ", "bb": "zwischen wasser kirche "}[l] * (1 + k % 3) * (4000 if k == 7 else 1), l, "was") for k, l in enumerate(["aa", "bb"] * 10)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string, LANGUAGE string")
    model = langid.train(df)
    got = langid.identify(df, model)
    assert [c.lower() for c in got.columns].count("language") == 1 and all(r.language == r.lang for r in got.collect()) and got.count() == 21


# ------------------------------------------------------------------ toxicity


def plain_logit(text, model):
    """The highest mean over passages of the mean over a word's rows, word by word."""
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())
    words = [x for k, x in enumerate(words) if not k or x != words[k - 1]]
    if not words:
        return math.nan
    value = []
    for word in words:
        w = words_of(pa.array([word]), "<", ">")
        rows, many = toxicity.subwords(w)
        marked = f"<{word}>"
        assert many[0] == len(rows) == 1 + sum(max(len(marked) - n + 1, 0) for n in toxicity.GRAMS)
        value.append(float(np.mean(model["lean"][rows], dtype=np.float64)))
    size = min(len(value), toxicity.PASSAGE)
    return max(sum(value[i : i + size]) / size for i in range(len(value) - size + 1))


def test_toxicity_scores_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    rng = random.Random(6)
    rows = [(i, sentence(rng, 30) + (" stinkhead dumbface " if i % 3 == 0 else " ") + sentence(rng, 10), int(i % 3 == 0)) for i in range(150)]
    odd = [(900, None, None), (901, "", None), (902, "...", None), (903, "w" * 3000, None), (904, sentence(rng, 20_000), None), (905, "so so so stinkheads", None), (900, rows[0][1], None), (None, rows[0][1], None)]
    df = spark.createDataFrame([r[:2] + ("a", "b") for r in rows + odd], "doc_id bigint, text string, Score string, extra string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.train(df.where("doc_id < 800"), labels)
    got = toxicity.classify(df, model)
    assert [c.lower() for c in got.columns].count("score") == 1 and got.count() == len(rows) + len(odd)
    text = {(r[0], r[1]): r for r in rows + odd}
    for r in got.collect():
        logit = plain_logit(text[r.doc_id, r.text][1], model)
        assert r.score == (0 if math.isnan(logit) else pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5))
        assert r.is_toxic == (not math.isnan(logit) and r.score >= 1 / (1 + math.exp(-model["threshold"])) - 1e-9)


def test_a_training_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    w = toxicity.bag_words(pa.array(["alpha beta gamma beta delta eps", "beta zeta eta theta iota alpha alpha kappa"]))
    rows, many = toxicity.subwords(w)
    distinct, rows = np.unique(rows, return_inverse=True)
    table, out = rng.normal(size=(len(distinct), 4)), rng.normal(size=(4, 2))
    shrink = rng.random(len(distinct)).astype(np.float32)
    size, label, weight = np.array([5, 3, 5]), np.array([0, 1, 1]), np.array([0.2, 0.5, 0.3])
    word = w.which[:13]

    def loss(table, out):
        first, total, at = np.cumsum(many) - many, 0.0, 0
        for n, y, c in zip(size, label, weight):
            mean = np.mean([np.mean([table[r] * shrink[r] for r in rows[first[x] : first[x] + many[x]]], axis=0) for x in word[at : at + n]], axis=0)
            logit = mean @ out
            total += c * (np.log(np.exp(logit).sum()) - logit[y])
            at += n
        return total

    of, grad, down = toxicity.gradients(table, out, rows, many, shrink, word, size, label, weight)
    for r in range(0, len(of), 7):
        for k in range(4):
            moved = table.copy()
            moved[of[r], k] += 1e-5
            assert (loss(moved, out) - loss(table, out)) / 1e-5 == pytest.approx(grad[r, k], abs=2e-4)
    for i in range(4):
        moved = out.copy()
        moved[i, 1] += 1e-5
        assert (loss(table, moved) - loss(table, out)) / 1e-5 == pytest.approx(down[i, 1], abs=2e-4)


# ------------------------------------------------------------------ token counts


def test_token_counts_do_not_depend_on_the_tables(spark, monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 60)) + rng.choice(["", "\n\n", " 漢字 ", "'s"]) for _ in range(400)] + [None, "", "x" * 4000, "same", "same"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, N_TOKENS string").repartition(40)  # two levels of sums
    coder = brute.plain_bpe()
    want = {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for frequent, cached, counted in ((bpe.FREQUENT, bpe.CACHED, bpe.COUNTED), (3, 50, 20), (1, 1, 1)):
        monkeypatch.setattr(bpe, "CACHED", cached)
        monkeypatch.setattr(bpe, "COUNTED", counted)
        out = bpe.token_counts(df, frequent=frequent)
        assert [c.lower() for c in out.columns].count("n_tokens") == 1 and {r.doc_id: r.n_tokens for r in out.collect()} == want


# ------------------------------------------------------------------ fingerprints


def test_fingerprints_without_known_items(spark):
    df = spark.createDataFrame([(1, sentence(random.Random(1), 50)), (2, None), (3, "")], "doc_id bigint, text string")
    made = fingerprint.digests(df, fingerprint.rarity(df))
    none = made.select("doc_id", "n_features", "digest").withColumnRenamed("doc_id", "item_id").limit(0)
    got = fingerprint.match(made, none).collect()
    assert len(got) == 3 and all(r.match_id is None and r.score == 0 and r.matches == [] for r in got)
