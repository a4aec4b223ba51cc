import numpy as np
import pytest

from tagwright.llm import embeddings


def brute(rows, threshold=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, n[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def vectors(spread):
    rng = np.random.default_rng(2)
    rows = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, float("nan")] + [0.0] * 14), (904, [float("inf")] + [0.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0])]
    centres = np.float32(rng.normal(size=(12, 16)))
    for k in range(240):
        v = np.float32(centres[k % 12] + spread * rng.normal(size=16))
        rows.append((k, v.tolist()))
    return [*rows, (300, rows[10][1]), (301, rows[10][1]), (10, rows[20][1]), (302, (2 * np.float32(rows[10][1])).tolist())]


@pytest.mark.parametrize(("spread", "tile_bytes"), [(0.05, embeddings.TILE_BYTES), (0.05, 1024), (0.25, 1024), (5.0, embeddings.TILE_BYTES)])
def test_equals_brute_force(spark, spread, tile_bytes):
    rows = vectors(spread)
    df = spark.createDataFrame([(i, v, "n") for i, v in rows], "vec_id long, embedding array<float>, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near(df, tile_bytes=tile_bytes).collect())
    assert got == brute(rows)


def test_pivots_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "choose_pivots", lambda sample, rows, threshold, probes: embeddings.unit(sample)[:9])
    rows = vectors(0.25)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near(df).collect()) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    u = embeddings.unit(rng.normal(size=(300, 48)) ** 3)
    q, s, e = embeddings.quantise(u)
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(about - u @ u.T) <= e[:, None] + (1 + e)[:, None] * e[None, :]).all()


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_compare_all_pairs(block):
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=(60, 6)), rng.normal(size=(45, 6))
    for other in (None, w):
        i, j = embeddings.near_pairs(v, other, 0.8, block)
        x, y = embeddings.unit(v), embeddings.unit(v if other is None else w)
        want = {(a, b) for a, b in zip(*np.nonzero(x @ y.T >= 0.8), strict=True) if other is not None or a < b}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_links_at_the_threshold_and_none_below():
    """Vectors a hair's breadth to either side of the threshold."""
    for step in range(-3, 4):
        cosine = 0.95 + step * 2.0**-53
        v = np.array([[1.0, 0.0], [cosine, (1 - cosine * cosine) ** 0.5]])
        x = embeddings.unit(v)
        i, _ = embeddings.near_pairs(v, None, 0.95)
        assert len(i) == int((x[0] * x[1]).sum() >= 0.95)


def test_pivots_grow_with_the_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 24))
    sample = (centres[rng.integers(0, 400, 6000)] + 0.01 * rng.normal(size=(6000, 24)))
    few, many = (len(embeddings.choose_pivots(sample, n, 0.95)) for n in (1000, 10**8))
    assert few < many


def test_empty_table(spark):
    assert embeddings.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
