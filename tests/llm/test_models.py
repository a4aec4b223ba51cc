import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tagwright.llm import language, maxent, quality

SF = "/root/testdata/sf0.01"


def made(seed, n):
    """Invented documents of two languages and two qualities."""
    rng = random.Random(seed)
    kinds = {"xa": ["ba", "do", "ki", "lu"], "yb": ["rén", "sto", "gra", "vim"]}
    rows = []
    for k in range(n):
        lang = "xa" if k % 3 else "yb"
        w = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 150))]
        good = k % 4 != 0
        rows.append((k, " ".join(w if good else [f"{x}###" for x in w]), lang, int(good)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(1, 400)


def test_language(spark, rows):
    odd = [(1000, None, "xa", 1), (1001, "", "xa", 1), (1002, "12 !!", "yb", 1), (1003, "bado kilu", None, 1), (1004, "rénsto " * 20_000, "yb", 0)]
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, *odd]], "doc_id long, text string, lang string, good int, lang_pred string")
    model = language.learn(docs.where((quality.remainder("doc_id", 4) != 2) & (F.col("doc_id") < 1000)))
    assert sorted(model) == ["xa", "yb"]
    got = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "xa", "yb"]


def plain_cosines(texts, prototypes=None):
    """Each text's vector, letter by letter, or its cosines with prototypes."""
    def letter(c):
        return language.vectors(np.array([[c]], np.uint32))[0].astype(float)

    out = []
    for t in texts:
        v = np.zeros(language.DIMENSIONS)
        word = [c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()]
        s = [ord(c) if c != " " else 0 for c in re.sub(" +", " ", "".join([" ", *word, " "]))]
        for k in range(len(s) - 2):
            if any(s[k : k + 3]):
                v += np.roll(letter(s[k]), 2) * np.roll(letter(s[k + 1]), 1) * letter(s[k + 2])
        out.append(v)
    if prototypes is None:
        return out
    return [{n: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for n, p in prototypes.items()} if v.any() else None for v in out]


def test_language_equals_dense_vectors(spark):
    train = [("bado kilu, Baki!", "xa"), ("lu", "xa"), ("rén\x00sto gra", "yb"), ("é", "yb"), ("vim1vim", "yb"), (None, "xa"), ("12", "xa")]
    tests = ["a", "é", "I", "a!", "中", "bad", "rensto", "\x01lu\x00", "", "7", "ba do" * 50, "İx"]
    model = language.learn(spark.createDataFrame(train, "text string, lang string"))
    for name in ("xa", "yb"):
        assert np.allclose(model[name], sum(plain_cosines([t for t, x in train if x == name and t])))
    docs = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    for k, c in enumerate(plain_cosines(tests, model)):
        if c is None:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
        else:
            assert c[got[k].lang_pred] >= max(c.values()) - 1e-6 and got[k].lang_pred != "und"
            soft = 1 / sum(math.exp(language.SHARPNESS * (x - c[got[k].lang_pred])) for x in c.values())
            assert abs(got[k].score - soft) < 1e-4


def test_alphabets_of_any_size():
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randrange(0, 9))) + " ab" for _ in range(300)]
    def told(found):
        row, number, counts, letters = found
        return sorted((int(r), *letters[k].tolist(), int(c)) for r, k, c in zip(row, number, counts, strict=True))
    whole = told(language.gram_counts(texts))
    assert told(language.gram_counts(texts, most=1 << 20)) == told(language.gram_counts(texts, most=1 << 24)) == whole


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    (r,) = language.predict(docs, language.learn(docs), ["doc_id"]).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.predict(docs.limit(0), {}, ["doc_id"]).count() == 0


def test_gram_vectors_are_bound_from_letters():
    row, number, counts, letters = language.gram_counts(["Abab", "", "b1a"])
    grams = Counter()
    for r, k, c in zip(row, number, counts, strict=True):
        grams[int(r), "".join(chr(x) if x else "_" for x in letters[k])] += int(c)
    assert grams[0, "aba"] == grams[0, "bab"] == 1 and all(r != 1 for r, _ in grams) and grams[2, "b_a"] == 1
    v = language.vectors(letters)
    assert v.shape == (len(letters), language.DIMENSIONS) and set(np.unique(v)) == {-1, 1}


def test_quality(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "bado " * 40_000, "x")], "doc_id long, text string, signal string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(5000, 1, 0), (1001, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels.where(quality.remainder("doc_id", 5) != 0))
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == q for i, _, _, q in held) >= 0.95 * len(held)
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == len(rows) + 3
    kept = {r.doc_id for r in quality.keep(docs, model, 0.3).collect()}
    assert kept == {i for i, x in got.items() if x >= 0.3} | {1000}


def test_quality_equals_compressing_text_by_text(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(1000, None), (1001, ""), (1002, "é" * 3000)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, _, q in rows if i % 3], "doc_id long, quality int"))
    sides = []
    for dictionary in (model.good, model.bad):
        known = zstandard.ZstdCompressionDict(dictionary)
        sides.append(lambda x, known=known: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(x)))
    for r in quality.score(docs, model).collect():
        text = (r.text or "").encode()
        parts = [text[k : k + quality.BLOCK] for k in range(0, len(text), quality.BLOCK)]
        good, bad = (sum(map(side, parts)) for side in sides)
        x = (bad - good) / len(text) if text else 0.0
        knots = list(zip(model.signals, model.scores, strict=True))
        if x <= knots[0][0]:
            y = knots[0][1]
        elif x >= knots[-1][0]:
            y = knots[-1][1]
        else:
            (a, p), (b, q) = next((u, v) for u, v in itertools.pairwise(knots) if u[0] <= x < v[0])
            y = p + (q - p) * (x - a) / (b - a)
        want = (len(text) * y + quality.SHRINK * model.mean) / (len(text) + quality.SHRINK)
        assert abs(r.quality_score - want) < 1e-9, r.doc_id


def test_quality_of_repeated_documents(spark, rows):
    """Repeated rows teach nothing new and don't come to the driver."""
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    again = docs.unionByName(docs.where("doc_id = 8").crossJoin(spark.range(3000)).select("doc_id", "text"))
    assert quality.fit(again, labels) == quality.fit(docs, labels)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(abs(r.quality_score - 0.5) < 1e-9 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where(quality.remainder("doc_id", 5) != 0))
    held = labels.where(quality.remainder("doc_id", 5) == 0)
    got = quality.score(docs.join(held, "doc_id"), model).select("quality", (F.col("quality_score") >= 0.3).cast("int").alias("p")).collect()
    good, bad = ([r.p for r in got if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_maxent_counts_and_probabilities(spark, rows):
    extra = [(2000, None), (2001, ""), (2002, "A\x0bb\u00a0c É"), (2003, "w " * 300_000), (2004, "unseen words here"), (2005, "bado"), (2005, "bado")]
    texts = [(i, t) for i, t, *_ in rows] + extra
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, block int").withColumn("held_out", quality.remainder("doc_id", 10) == 0)
    got = maxent.score(docs, maxent.fit(docs.where("not held_out"))).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    c = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            c.update(cut(t))
    n, kinds = sum(c.values()), len(c)
    want = sorted((i, len(w := cut(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (kinds + 1))) for x in w), 4)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


MASK = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_chances(model, one, two):
    """The chance of every leaf after the leaves ``one`` and ``two``, by walking the whole tree in plain Python."""
    found = [plain_mix((one + 1) & MASK), plain_mix((one * 3 + plain_mix(two)) & MASK), plain_mix((two * 5 + 2) & MASK)]
    kept = {}

    def node_chances(node):
        if node not in kept:
            x = [float(v) for v in model.leaves.shares[node]]
            for f in found:
                row = plain_mix((f + node * 0x9E3779B97F4A7C15) & MASK) % len(model.values)
                x = [a + float(b) for a, b in zip(x, model.values[row], strict=True)]
            e = [math.exp(min(v, 60)) for v in x]
            kept[node] = [v / sum(e) for v in e]
        return kept[node]

    out = []
    for nodes, children in zip(model.leaves.nodes.tolist(), model.leaves.children.tolist(), strict=True):
        p = 1.0
        for node, child in zip(nodes, children, strict=True):
            p *= node_chances(node)[child] if node >= 0 else 1.0
        out.append(p)
    return out


def vocabulary_of(model):
    return {int(h): (int(t), int(c)) for r in model.vocabulary.collect() for h, t, c in zip(np.frombuffer(r.h, np.uint64), np.frombuffer(r.tail, np.uint16), np.frombuffer(r.c, np.uint64), strict=True)}


def test_maxent_equals_a_dense_model(spark):
    rng = random.Random(3)
    names = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join(rng.choices(names, range(1, 21), k=rng.randrange(1, 60)) + (["rare%d" % k] if k % 9 == 0 else []))) for k in range(150)]
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in rows] + [(900, "w1 never seen", True)], "doc_id long, text string, held_out boolean")
    model = maxent.fit(docs.where("not held_out"))
    known = vocabulary_of(model)
    assert sum(c for _, c in known.values()) == model.n and len(known) == model.kinds
    got = {r.doc_id: r.score for r in maxent.score(docs, model).collect()}
    dense = {}
    for i, t in [*rows[::10], (900, "w1 never seen")]:
        h, tail, row = maxent.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        leaf, place = model.leaves.of(h, tail)
        before, total = [int(maxent.START)] * 2, 0.0
        for x, k, own in zip(h.tolist(), leaf.tolist(), place.tolist(), strict=True):
            if tuple(before) not in dense:
                dense[tuple(before)] = plain_chances(model, before[-1], before[-2])
                assert math.isclose(sum(dense[tuple(before)]), 1, abs_tol=1e-6)
            inside = 1.0 if own >= 0 else (known.get(x, (0, 0))[1] + maxent.ALPHA) / 10 ** model.leaves.norm[k]
            total += math.log10(dense[tuple(before)][k] * inside)
            before = [before[-1], k]
        assert math.isclose(got[i], total, rel_tol=1e-4), i


def test_maxent_leaves_share_all_tokens(spark, rows):
    model = maxent.fit(spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string"))
    known = vocabulary_of(model)
    h = np.array(sorted(known), np.uint64)
    tail, c = (np.array([known[int(x)][k] for x in h]) for k in (0, 1))
    leaf, place = model.leaves.of(h, tail)
    shared = model.leaves.norm != 0
    for k in range(len(model.leaves.norm)):
        at = (leaf == k) & (place < 0)
        if at.any():
            assert math.isclose(10 ** model.leaves.norm[k], (c[at] + maxent.ALPHA).sum() + maxent.ALPHA, rel_tol=1e-9)
    assert (c[place < 0] <= c[place >= 0].min()).all() and shared[leaf[place < 0]].all()


def test_maxent_grows_with_the_corpus():
    sizes = [maxent._size(n, maxent.ROWS_PER_ROOT, maxent.ROWS) for n in (0, 10**6, 10**8, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == maxent.ROWS[0] < sizes[2] < sizes[3]
    rng = np.random.default_rng(0)
    for n in (1, 2, 16, 17, 300, 5000):
        mass = rng.zipf(1.3, n).clip(1, 10**6).astype(float)
        nodes, children, shares = maxent.tree(mass)
        assert len({tuple(zip(a, b, strict=True)) for a, b in zip(nodes.tolist(), children.tolist(), strict=True)}) == n
        chance = np.ones(n)
        for k in range(nodes.shape[1]):
            chance *= np.where(nodes[:, k] >= 0, np.exp(shares[nodes[:, k], children[:, k]]), 1)
        assert np.allclose(chance, mass / mass.sum(), rtol=1e-4)
        assert (children < maxent.WIDTH).all()


def test_maxent_without_training(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = maxent.score(docs, maxent.fit(docs.limit(0))).collect()
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and abs(r.score) < 1e-6 for r in got)
    assert maxent.score(docs.limit(0), maxent.fit(docs.limit(0))).count() == 0
