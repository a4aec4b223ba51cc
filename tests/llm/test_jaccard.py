import random

import pyarrow as pa
import pytest

from tagwright.llm import jaccard
from tagwright.llm.components import components


def brute(rows, threshold=0.8):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                shared = len(sets[a] & sets[b])
                if shared >= threshold * len(sets[a] | sets[b]):
                    n[a] += 1
                    n[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, least.get(root(k)), n[k]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "word " * 3000), (None, "one two"), (906, "x y z a b"), (906, "x y z a b")]
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(5, {}), (5, {"tile": 4}), (5, {"tile": 4, "group_tiles": 1}), (7, {}), (8, {"probes": 0})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed, 25, 12)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs, **options).collect()), key=str)
    assert got == brute(rows)


def test_links_are_the_same_whatever_the_tiles(spark):
    """With few trees pairs are missed: the same ones in small groups and in large ones."""
    docs = spark.createDataFrame([(a, b) for a, b in corpus(9, 6, 30)], "doc_id long, text string")
    got = [sorted(map(tuple, jaccard.join(docs, trees=2, recall=0.5, **options).collect()), key=str) for options in ({}, {"tile": 5}, {"tile": 5, "group_tiles": 0})]
    assert got[0] == got[1] == got[2]
    assert sum(r[2] for r in got[0]) < sum(r[2] for r in brute(corpus(9, 6, 30)))


def test_matched_prefixes_and_their_recall():
    """The noted prefixes are those that brute force finds."""
    texts = [t for _, t in corpus(11, 12, 30) if t and 5 <= len(t.split()) < 1000]
    some = texts[::5]
    known, signed = jaccard.probes_of(some, 1, 5, 5), [jaccard.probes_of([t], 1, 5, 5).keys[0] for t in texts]
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {}
    for a, x in zip(sets, signed, strict=True):
        for b, y in zip(sets[::5], signed[::5], strict=True):
            if a != b and len(a & b) >= 0.8 * len(a | b):
                most = max(next((d for d in range(5, 0, -1) if int(i) >> 12 * (5 - d) == int(j) >> 12 * (5 - d)), 0) for i, j in zip(x, y, strict=True))
                want[most] = want.get(most, 0) + 1
    (batch,) = jaccard._sign(1, 5, 5, known, 0.8)([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])
    got = {}
    for found in batch.column("matched").to_pylist():
        for d in found:
            got[d] = got.get(d, 0) + 1
    assert got == want and sum(want.values()) > 50 and len(want) > 2


def test_representatives_keep_one_of_each_class(spark):
    rows = corpus(6, 8, 5)
    docs = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], "doc_id long, text string, class_id int")
    kept = jaccard.representatives(docs).collect()
    want = {c for i, c, _ in brute(rows) if i is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 1


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_until_the_recall():
    plain = jaccard.shorten({}, 0.8)
    assert 1 - (1 - 0.8**plain) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (plain + 1)) ** jaccard.TREES
    assert jaccard.shorten({5: 10_000}, 0.8) == plain and jaccard.shorten({5: 10_000}, 0.99) == jaccard.DEPTH
    assert jaccard.shorten({5: 900, 4: 90, 3: 10}, 0.8) == 3 and jaccard.shorten({5: 900, 0: 1}, 0.8) == 1


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (259, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {5} and len(got) == 61 + 1 + 60
