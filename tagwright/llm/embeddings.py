"""Embedding near-duplicates by int8 tile products.

Unit vectors are quantised to int8 with a scale of their own. The length of what the quantisation
left out is known for each vector, so a product of two quantised vectors bounds the true cosine
rigorously from both sides: only pairs whose bounds hold the threshold between them are
computed again in double precision. Integer products are exact: they are made in float32, in
which sums below 2**24 are.

Which vectors meet: each has its nearest pivot as home. Two vectors at an angle of at most a have
homes that neither is farther from than from its own by more than 2a, so a vector visits the cells
of all such pivots and no pair can be missed. The pivots are some of the vectors themselves; how
many, is chosen by what the cells would cost, measured on the same sample. Cells are cut into
tiles of TILE_BYTES, and every two tiles meet in a task of their own, which compares them block by block and
returns counts and a spanning forest, never the pairs. The more vectors, the more pivots may be chosen.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths aren't compared; equal vectors are one node, so a hot
group of copies costs one row; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.components import components
from tagwright.llm.storage import materialise
from tagwright.llm.tiles import LINKS, tiled

THRESHOLD = 0.95
#: Bytes of a tile's vectors, and rows of a block in it.
TILE_BYTES = 4 << 20
BLOCK = 1536
#: Vectors that go to the driver to measure what cells cost, and possible pivots: so many times the root of the rows.
SAMPLE = 4096
PIVOTS_PER_ROOT = 0.5
#: float32 holds sums of so many products of two int8 exactly.
EXACT_DIMENSIONS = 1024


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, first scaled so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and the lengths of what is left out, rounded up."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    left = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.int8), scale, left * (1 + 1e-9) + 1e-12


class Quantised:
    """Unit vectors and their int8 form."""

    def __init__(self, v: np.ndarray):
        self.u = unit(v)
        q, self.scale, self.error = quantise(self.u)
        self.q = q.astype(np.float32)

    def part(self, lo: int, hi: int) -> Quantised:
        out = object.__new__(Quantised)
        out.u, out.q, out.scale, out.error = self.u[lo:hi], self.q[lo:hi], self.scale[lo:hi], self.error[lo:hi]
        return out


def _near(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b whose cosine reaches the threshold."""
    about = np.zeros((len(a.u), len(b.u)), np.float64)
    for k in range(0, a.u.shape[1], EXACT_DIMENSIONS):
        about += a.q[:, k : k + EXACT_DIMENSIONS] @ b.q[:, k : k + EXACT_DIMENSIONS].T
    about *= a.scale[:, None]
    about *= b.scale[None, :]
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, lengths of x' at most 1 + its error
    bound = a.error[:, None] + (1 + a.error)[:, None] * b.error[None, :] + 1e-9
    about += bound
    i, j = np.nonzero(about >= threshold)
    sure = about[i, j] - 2 * bound[i, j] >= threshold
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        open_ = ~sure[lo : lo + (1 << 16)]
        x, y = x[open_], y[open_]
        sure[lo + np.flatnonzero(open_)] = (a.u[x] * b.u[y]).sum(1) >= threshold
    return i[sure], j[sure]


def near_pairs(v: np.ndarray, w: np.ndarray | None, threshold: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of v and w (or of v alone) whose cosine reaches the threshold."""
    a = Quantised(v)
    b = a if w is None else Quantised(w)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x in range(0, len(a.u), block):
        for y in range(x if w is None else 0, len(b.u), block):
            i, j = _near(a.part(x, x + block), b.part(y, y + block), threshold)
            i, j = i + x, j + y
            if w is None:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def choose_pivots(sample: np.ndarray, rows: int, threshold: float, probes: int = SAMPLE) -> np.ndarray:
    """The first so many vectors of the sample with which comparing ``rows`` vectors costs least, as its last ones tell."""
    u, wide = unit(sample), 2 * np.arccos(threshold)
    best, k = (np.inf, 1), 1
    while k <= max(1, len(u) // 4):
        some = u[-max(256, min(probes, (1 << 24) // k)) :]
        angle = _angles(some, u[:k])
        home = angle.argmin(1)
        visits = (angle <= angle.min(1, keepdims=True) + wide + 1e-9) & (np.arange(k)[None, :] < home[:, None])
        homes, guests = np.bincount(home, minlength=k) / len(some), visits.sum(0) / len(some)
        pairs = float((homes * homes / 2 + homes * guests).sum()) * rows * rows
        cost = pairs + rows * (1 + guests.sum()) * 2000 + rows * k * 4
        best = min(best, (cost, k))
        k *= 4
    return u[: best[1]]


def _cells(pivots: dict[int, np.ndarray], threshold: float):
    """(node, dim, cell, guest) of each vector's cells."""
    wide = 2 * float(np.arccos(threshold)) + 1e-9

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                own = pivots.get(d, np.ones((1, d)))  # a rare length has one cell
                step = max(64, min(2048, (1 << 22) // len(own)))
                for lo in range(0, len(at), step):
                    rows = pa.array(at[lo : lo + step])
                    angle = _angles(unit(_matrix(batch.column("v").take(rows))), own)
                    home = angle.argmin(1)
                    guest = (angle <= angle.min(1, keepdims=True) + wide) & (np.arange(len(own))[None, :] < home[:, None])
                    x, cell = np.nonzero(guest)
                    node = batch.column("node").take(rows).to_numpy()
                    n = len(node) + len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([node, node[x]])), pa.array(np.full(n, d, np.int64)), pa.array(np.concatenate([home, cell]).astype(np.int64)), pa.array(np.repeat([0, 1], [len(node), len(x)]).astype(np.int64))],
                        ["node", "dim", "cell", "guest"],
                    )

    return run


def _linked(threshold: float):
    def run(group: pa.Table, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = _matrix(group.column("v"))
        if not side.any():
            return near_pairs(v, None, threshold)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return left[:0], left[:0]
        i, j = near_pairs(v[left], v[right], threshold)
        return left[i], right[j]

    return run


def near(vectors: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    big = F.array_max(F.transform("v", F.abs))  # a NaN is the largest of all
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()) & (big > 0) & (big < F.lit(float("inf")))
    signed = materialise(rows.select("vec_id", F.when(fine, F.xxhash64("v")).alias("node"), F.when(fine, F.col("v")).alias("v")), "vectors")
    copies = signed.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = materialise(copies.withColumn("dim", F.size("v").cast("long")), "nodes")
    counts = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    pivots = {}
    for dim, n in counts.items():
        some = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(max(sample, int(4 * PIVOTS_PER_ROOT * n**0.5))).select("v").collect()
        pivots[dim] = choose_pivots(np.array([r["v"] for r in some]), n, threshold, sample)
    placed = materialise(nodes.select("node", "dim", "v").mapInArrow(_cells(pivots, threshold), "node long, dim long, cell long, guest long"), "cells")
    tile = F.greatest(F.lit(1), F.floor(F.lit(tile_bytes) / (8 * F.col("dim"))))
    size = placed.groupBy("dim", "cell").agg(*(F.greatest(F.lit(k), F.ceil(F.count(F.when(F.col("guest") == 1 - k, 1)) / tile)).cast("long").alias(name) for name, k in (("homes", 1), ("guests", 0))))
    sized = placed.join(materialise(size, "size"), ["dim", "cell"])
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("guest") == 1, F.col("guests")).otherwise(F.col("homes"))) + F.when(F.col("guest") == 1, F.col("homes")).otherwise(0)
    # a home tile meets all tiles of its cell, a tile of guests only home tiles
    upto = F.when(F.col("guest") == 1, F.col("homes")).otherwise(F.col("homes") + F.col("guests"))
    met = sized.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
    pairs = met.select("node", (F.col("own") > F.col("with")).cast("int").alias("side"), F.xxhash64("dim", "cell", F.least("own", "with"), F.greatest("own", "with")).alias("gid"))
    laid = pairs.join(nodes.select("node", "weight", "v"), "node")
    found = materialise(laid.repartition("gid").sortWithinPartitions("gid").mapInArrow(tiled(_linked(threshold)), LINKS), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = nodes.select("node", "rep", "weight").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = materialise(told.select("node", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "told")
    least = told.groupBy("component").agg(F.min("rep").alias("component_id"))
    about = materialise(told.join(least, "component").select("node", "component_id", "n_links"), "about")
    out = signed.select("vec_id", "node").join(about, "node", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: The same rows by comparing all pairs.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     f AS (SELECT r, len(v) AS n, v FROM d WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
     p AS (SELECT a.r AS x, b.r AS y FROM f a JOIN f b ON a.n = b.n AND a.r < b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
     e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
     reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
     least AS (SELECT x AS r, min(vec_id) AS component_id FROM reach JOIN d ON y = d.r GROUP BY x),
     links AS (SELECT x AS r, count(*) AS k FROM e GROUP BY x)
SELECT d.vec_id, coalesce(k, 0) AS n_links, component_id, d.vec_id = component_id AS kept FROM d JOIN least USING (r) LEFT JOIN links USING (r)
"""
