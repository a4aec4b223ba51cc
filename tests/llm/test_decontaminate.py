import math
import random
import re

import duckdb
import pytest

from tagwright.llm import decontaminate


def brute(docs, items, threshold=0.8):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, t in items:
        w = cut(t)
        k = min(5, len(w))
        own = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
        for d, text in docs:
            v = cut(text)
            shared = len(own & {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}) if own else 0
            if own and shared >= threshold * len(own):
                out.add((d, i, len(own), shared))
    return out


@pytest.mark.parametrize(("seed", "options"), [(4, {}), (5, {"broadcast_rows": 100}), (6, {"sketch": 4})])
def test_equals_brute_force(spark, seed, options):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice((rng.randrange(1, 8), rng.randrange(1, 60), rng.randrange(60, 300)))))) for k in range(40)] + [(90, None), (91, "..."), (92, "solo"), (93, items_text := "a b c d e f g"), (94, items_text)]
    docs = [(900, None), (901, ""), (902, "solo!"), (903, "x A b, c D e-f g y")]
    for k in range(60):
        w = [word() for _ in range(rng.randrange(1, 200))]
        if k % 2:
            inside = items[rng.randrange(40)][1].split()
            for _ in range(rng.randrange(0, 3)):
                inside[rng.randrange(len(inside))] = word()
            at = rng.randrange(len(w))
            w = w[:at] + inside + w[at:]
        docs.append((k, " ".join(w)))
    docs += [docs[5], (7, "long " * 20_000 + items[3][1])]
    one = {}
    for d, t in docs:  # rows with one doc_id count as one text; a separator keeps shingles apart
        one[d] = f"{one[d]} {' zzz' * 5} {t}" if d in one else t
    got = decontaminate.search(spark.createDataFrame([(d, t, "h") for d, t in docs], "doc_id long, text string, h string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    rows = got.collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == brute(list(one.items()), items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.search(none, items).count() == 0
    assert decontaminate.search(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_partitions_have_the_recall():
    """Every size's own chance of enough hits, by counting samples."""
    parts = decontaminate.partitions(5000)
    assert [p[0] for p in parts[:3]] == [32, 64, 128] and [p[1] for p in parts] == sorted(p[1] for p in parts) and parts[-1][0] >= 5000
    assert len({p[1:] for p in parts}) > 3
    for most, size, hits in parts[:5]:
        for n in range(most // 2 + 1, most + 1):
            inside = math.ceil(0.8 * n - 1e-9)
            taken = min(size, n)  # a small item's sketch is whole
            chance = sum(math.comb(inside, k) * math.comb(n - inside, taken - k) for k in range(hits, taken + 1)) / math.comb(n, taken)
            assert chance >= decontaminate.RECALL, (n, size, hits)


def test_recall_of_items_at_the_threshold(spark):
    """Long items with a fifth of their shingles gone: all are found, at several seeds."""
    for seed in range(3):
        rng = random.Random(seed)
        items, docs = [], []
        for k in range(60):
            w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 400))]
            items.append((k, " ".join(w)))
            docs.append((k, " ".join(["x"] * 50 + w[: math.ceil(0.8 * (len(w) - 4) - 1e-9) + 4] + ["y"] * 50)))
        got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(60)]


def test_sql_covers_short_items(spark):
    items = [(1, "solo"), (2, "one two"), (3, "a b c d"), (4, "a b c d e f g"), (5, None), (6, "...")]
    docs = [(1, "x solo y"), (2, "two one two"), (3, "A b-c d! e f g"), (4, None), (3, "one, two")]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(map(tuple, got)) == sorted(con.execute(decontaminate.SQL).fetchall()) and len(got) == 5
