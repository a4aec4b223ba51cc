"""N-gram Jaccard join with a MinHash LSH forest.

A document is the set of its five-word shingles (words between white space, lower-cased; a text
of fewer words is one shingle). Documents with equal sets are one node. In each tree of a forest a node
has a signature of DEPTH minima, packed so that the order of the numbers is the order of a trie: a
prefix is a number's upper part. Nodes that match on a prefix are candidates.

How long a matched prefix must be is found from the data. Some documents, the probes, are compared with
every document exactly while it is signed; of each pair above the threshold the longest prefix that it
matches in any tree is noted. The prefixes start at full depth and are shortened, a minimum at a time, until
the share ``recall`` of the probes' pairs match, and a pair right at the threshold would with that probability.
Candidates are verified by the exact Jaccard similarity of their sets; a link is a pair that matches in some tree and
reaches the threshold, whatever the size of the group it is found in.

Nodes that hang together by candidate prefixes are verified as one group: a group's sets travel
once, and its similarities are computed as matrix products. Groups of more than TILE nodes, or of
many shingles, are cut into tiles, and every two tiles meet in a task of their own; what leaves a
task is the number of links of each node and a spanning forest, never the pairs.

Cases: null and empty texts, or those without words, have no shingle and link with nothing, and
neither do rows without a doc_id, whose class is null; repeated rows are copies of each other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.components import components
from tagwright.llm.kernels import buffers, mix, shingles, slices, tokens, trim
from tagwright.llm.storage import materialise, release, small_batches
from tagwright.llm.tiles import LINKS, tiled

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 5
#: Bits of a signature for each minimum.
BITS = 12
RECALL = 0.9999
#: Documents that recall is measured with, and the shingles they have together at most.
PROBES = 256
PROBE_SHINGLES = 200_000
#: Nodes and shingles of a tile, which bound a task's memory.
TILE = 192
TILE_SHINGLES = 1_000_000
#: A group of more tiles than this isn't verified whole but prefix by prefix, which costs more
#: copies of the sets but no look at pairs that never match. Both give the same links.
GROUP_TILES = 64


def shorten(matched: dict[int, int], threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the recall. matched: of the probes' pairs, how many match on how many minima at most."""
    total = sum(matched.values())
    while depth > 1:
        found = sum(n for d, n in matched.items() if d >= depth)
        if found >= recall * total and 1 - (1 - threshold**depth) ** trees >= recall:
            break
        depth -= 1
    return depth


def shingle_sets(column: pa.Array, words: int = WORDS):
    """(first row, last row, sorted set of shingle hashes of each row between) of a column, block by block."""
    column = pc.utf8_lower(pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, ""))
    data, at = buffers(column)
    for lo, hi in slices(at):
        got, row, _, _ = tokens(data, at[lo : hi + 1])
        h, of = shingles(got, row, hi - lo, words)
        ends = np.searchsorted(of, np.arange(hi - lo + 1))
        yield lo, hi, [np.unique(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _node(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its members."""
    return mix(np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)).view(np.int64)


def _signer(trees: int, depth: int):
    """A function from sets, laid end to end from ``starts`` on, to their signatures, one for each tree."""
    rng = np.random.default_rng(20)
    factor, plus = (rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def run(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(starts), trees), np.int64)
        for k in range(trees * depth):
            low = mix(np.minimum.reduceat(flat * factor[k] + plus[k], starts))
            keys[:, k // depth] = (keys[:, k // depth] << BITS) | (low >> np.uint64(64 - BITS)).astype(np.int64)
        return keys

    return run


@dataclass
class Probes:
    """Sets that every document is compared with: their shingles in order, whose they are, sizes, nodes and signatures."""

    shingles: np.ndarray
    owner: np.ndarray
    n: np.ndarray
    node: np.ndarray
    keys: np.ndarray

    def linked(self, flat: np.ndarray, row: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, probe) of the pairs that reach the threshold."""
        if not len(self.n) or not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(self.shingles, flat)
        hit = np.flatnonzero(self.shingles[np.minimum(lo, len(self.shingles) - 1)] == flat)
        lo = lo[hit]
        many = np.searchsorted(self.shingles, flat[hit], "right") - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pairs, shared = np.unique(np.repeat(row[hit], many) * len(self.n) + self.owner[at], return_counts=True)
        x, probe = pairs // len(self.n), pairs % len(self.n)
        ok = shared >= threshold * (n[x] + self.n[probe] - shared) - 1e-9
        return x[ok], probe[ok]


def probes_of(texts: list[str], trees: int, depth: int, words: int, most: int = PROBE_SHINGLES) -> Probes:
    sets, held = [], 0
    for _, _, some in shingle_sets(pa.array(texts, pa.string()), words):
        for x in some:
            if len(x) and held + len(x) <= most:
                sets.append(x)
                held += len(x)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum(n) - n
    order = np.argsort(flat, kind="stable")
    node = _node(flat, starts) if len(sets) else np.zeros(0, np.int64)
    keys = _signer(trees, depth)(flat, starts) if len(sets) else np.zeros((0, trees), np.int64)
    return Probes(flat[order], np.repeat(np.arange(len(sets)), n)[order], n, node, keys)


def matched_depth(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """On how many minima rows of signatures match, in the tree where most do."""
    out = np.zeros(len(a), np.int64)
    for d in range(1, depth + 1):
        out[((a ^ b) >> (BITS * (depth - d)) == 0).any(1)] = d
    return out


def _sign(trees: int, depth: int, words: int, probes: Probes, threshold: float):
    sign = _signer(trees, depth)

    def run(batches):
        for batch in batches:
            for lo, hi, sets in shingle_sets(batch.column("text"), words):
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(n)
                node, keys, matched = np.zeros(len(sets), np.int64), np.zeros((len(sets), trees), np.int64), [[] for _ in sets]
                if len(some):
                    flat, starts = np.concatenate(sets), (np.cumsum(n) - n)[some]
                    node[some], keys[some] = _node(flat, starts), sign(flat, starts)
                    x, probe = probes.linked(flat, np.repeat(np.arange(len(sets)), n), n, threshold)
                    other = node[x] != probes.node[probe]
                    for i, d in zip(x[other].tolist(), matched_depth(keys[x[other]], probes.keys[probe[other]], depth).tolist(), strict=True):
                        matched[i].append(d)
                empty = pa.array(n == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * trees), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pc.if_else(empty, None, pa.array(node)), pa.array(n), lists, pa.array(matched, pa.list_(pa.int32()))], ["doc_id", "node", "n", "keys", "matched"])
            trim()

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column("text"), words):
                sets = [s for s in sets if len(s)]
                if sets:
                    n = np.fromiter(map(len, sets), np.int64, len(sets))
                    node = _node(np.concatenate(sets), np.cumsum(n) - n)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
            trim()

    return run


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many members each two sets share."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(first, len(flat)))
    shared = np.zeros(m * m, np.int64)
    for c in range(2, 9):  # what few sets share: pair by pair
        at = first[count == c]
        for a in range(c):
            for b in range(a + 1, c):
                if len(at):
                    shared += np.bincount(owner[at + a] * m + owner[at + b], minlength=m * m)
    shared = shared.reshape(m, m)
    shared = (shared + shared.T).astype(np.float64)
    wide = np.flatnonzero(count > 8)  # what many share: as products of a table of 0 and 1
    for lo in range(0, len(wide), width):
        some = wide[lo : lo + width]
        table = np.zeros((m, len(some)), np.float32)
        at = np.concatenate([np.arange(a, a + c) for a, c in zip(first[some].tolist(), count[some].tolist(), strict=True)])
        table[owner[at], np.repeat(np.arange(len(some)), count[some])] = 1
        shared += table @ table.T
    return shared


def _linked(threshold: float, cut: int):
    def run(group: pa.Table, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        n = np.fromiter(map(len, sets), np.float64, len(sets))
        shared = overlaps(sets)
        linked = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
        if side.any():
            linked &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(linked, 1))
        keys = np.stack(group.column("keys").to_pylist()) >> cut
        meet = keys[i] == keys[j]
        tree = group.column("tree").to_numpy()[0]
        # in a prefix's own group, pairs that match in an earlier tree are counted there
        ok = meet.any(1) if tree < 0 else meet[:, tree] & ~meet[:, :tree].any(1)
        return i[ok], j[ok]

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile: int = TILE, group_tiles: int = GROUP_TILES, probes: int = PROBES) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, class_id (the smallest doc_id it hangs together with) and n_links (other rows of that similarity)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = F.lit(max(1, rows.count() // max(1, probes)))
    likely = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(9)), every) == 0) & F.col("doc_id").isNotNull() & F.length("text").between(1, 100_000))
    known = probes_of([r["text"] for r in likely.select("text").limit(probes).collect()], trees, depth, words)
    signed = rows.mapInArrow(_sign(trees, depth, words, known, threshold), "doc_id long, node long, n long, keys array<long>, matched array<int>")
    with small_batches(docs.sparkSession):
        signed = materialise(signed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), "signed")
    matched = {r["d"]: r["n"] for r in signed.select(F.explode("matched").alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect()}  # depth + 1 rows
    cut = BITS * (depth - shorten(matched, threshold, trees, depth, recall))
    nodes = materialise(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")

    met = nodes.select("node", F.posexplode("keys").alias("tree", "signature")).select("node", "tree", F.shiftright("signature", cut).alias("key"))
    buckets = met.groupBy("tree", "key").agg(F.count("*").alias("c"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("c > 1")
    # many prefixes hold the same nodes: one of them is enough
    buckets = materialise(buckets.groupBy("c", "least", "who").agg(F.min(F.struct("tree", "key")).alias("b")).select("b.tree", "b.key", "least", "c"), "buckets")
    members = materialise(met.join(buckets, ["tree", "key"]).select("node", "tree", "key", "least"), "members")
    comps = materialise(components(members.select(F.col("node").alias("a"), F.col("least").alias("b"))), "comps")

    known = comps.join(nodes.select("node", "n", "rep", "weight"), "node")
    size = materialise(known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles")), "size")
    placed = known.join(size, "component")
    whole = placed.where(F.col("tiles") <= group_tiles).select("node", "weight", "tiles", F.lit(-1).alias("tree"), F.xxhash64("component").alias("g"))
    vast = placed.where(F.col("tiles") > group_tiles)
    sums = members.join(vast.select("node", "n", "weight"), "node")
    per = sums.groupBy("tree", "key").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    apart = sums.join(materialise(per, "per"), ["tree", "key"]).select("node", "weight", "tiles", "tree", F.xxhash64("tree", "key").alias("g"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles"))
    pairs = (
        whole.unionByName(apart)
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("node", "weight", "tree", (F.col("own") > F.col("with")).cast("int").alias("side"), F.xxhash64("g", "tree", F.least("own", "with"), F.greatest("own", "with")).alias("gid"))
    )
    wanted = placed.select(F.col("rep").alias("doc_id")).distinct()
    with small_batches(docs.sparkSession):
        sets = materialise(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "node long, shingles binary"), "sets")
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # rows that share a representative's doc_id
        sets = materialise(sets.dropDuplicates(["node"]), "sets")
    laid = pairs.join(sets, "node").join(nodes.select("node", "keys"), "node")
    found = laid.repartition("gid").sortWithinPartitions("gid").mapInArrow(tiled(_linked(threshold, cut)), LINKS)
    with small_batches(docs.sparkSession):
        found = materialise(found, "links")
    for t in (buckets, members, sets):
        release(t)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = nodes.select("node", "rep", "weight").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = materialise(told.select("node", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "told")
    classes = told.groupBy("component").agg(F.min("rep").alias("class_id"))
    about = materialise(told.join(classes, "component").select("node", "class_id", "n_links"), "about")
    out = signed.select("doc_id", "node").join(about, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class: that with the smallest doc_id. Of rows with equal doc_id and text one stays; rows without a doc_id stay."""
    about = materialise(join(docs, **options), "classes")
    gone = materialise(about.where("class_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialise(about.where("class_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


#: The same rows by comparing all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT r, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0 AND doc_id IS NOT NULL)),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
     p AS (SELECT x, y FROM c JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
     e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
     reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
     least AS (SELECT x AS r, min(doc_id) AS class_id FROM reach JOIN d ON y = d.r GROUP BY x),
     links AS (SELECT x AS r, count(*) AS k FROM e GROUP BY x)
SELECT d.doc_id, class_id, coalesce(k, 0) AS n_links FROM d JOIN least USING (r) LEFT JOIN links USING (r)
"""
