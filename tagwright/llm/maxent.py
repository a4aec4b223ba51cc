"""Hashed maximum-entropy language model with a class-factored softmax.

Words (lower-cased, between ASCII white space, and one end for each text) hang in a tree of classes: a
node has WIDTH children, classes or leaves, of about equal numbers of training tokens. Frequent
words are leaves of their own; the others share leaves by their ending and their hash, and have in
their leaf the smoothed share of its training tokens, with room for one unseen word a leaf. The chance of a
word is the product of softmaxes on its way down the tree, so all chances of a place add up to 1. A
child's logit is the log of its share of the node's tokens plus the weights of three hashed
features, made of the leaves of the words before: the last, the last two, and the last but one alone
(a skip). Without weights the model is the smoothed unigram model; the weights say what the words
before change.

Leaves and rows of weights grow with the square root of the training tokens, so the model covers the whole
vocabulary at every size; LEAVES and ROWS bound what one task holds.

Training passes once over all training text, in rounds. In a round each task makes AdaGrad steps from the same
weights on its part of the scan, and each row of weights moves by the mean of the tasks' moves,
weighted by how often each task met the row: what moves is proportional to the text, and the driver gets
one model. Word counts are a table that grows with the corpus and is never broadcast. Frequent
words' counts are in the model; of the others, each block of scored texts asks for its own kinds of words,
packed by buckets of hashes, and gets their counts back. No text is shuffled.

Cases: a null text is empty and has one token, the end; without training rows every score is 0;
repeated rows are scored each time they come; words are told apart by 64-bit hashes; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.kernels import LOWER, buffers, mix, slices, tokens
from tagwright.llm.storage import materialise, text_bytes

ALPHA = 0.1
WIDTH = 16
#: Least and most leaves, and rows of weights; between, in proportion to the square root of the tokens.
LEAVES = (256, 1 << 16)
ROWS = (1 << 15, 1 << 20)
LEAVES_PER_ROOT, ROWS_PER_ROOT = 0.5, 16
ROUNDS = 3
RATE = 0.3
#: What a row's sum of squares starts with: the larger, the less a feature seen once says.
DAMP = 1.0
BATCH = 8192
#: Bytes of text of a training task, of a block of scored texts, and of text for each bucket of words.
TASK_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Distinct words that a counting task holds.
HELD = 1 << 20
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0x3C6EF372FE94F82B)
#: Pieces in which weights are added up.
CHUNKS = 64


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a block: word hashes with the end of the row, last two bytes, and the row."""
    h, row, _, stop = tokens(data, at)
    n = len(at) - 1
    tail = LOWER[data[np.maximum(stop - 2, 0)]].astype(np.int32) * 256 + LOWER[data[stop - 1]]
    ends = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, ends, END), np.insert(tail, ends, 0), np.insert(row, ends, np.arange(n))


def blocks(batch: pa.RecordBatch, most: int = 1 << 20):
    data, at = buffers(batch.column("text"))
    for lo, hi in slices(at, most):
        yield lo, hi, *words(data, at[lo : hi + 1])


def features(leaf: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the features at each place."""
    word = leaf.astype(np.uint64)
    one, two = np.full(len(word), START), np.full(len(word), START)
    one[1:] = np.where(row[1:] == row[:-1], word[:-1], START)
    two[2:] = np.where(row[2:] == row[:-2], word[:-2], START)
    return [mix(one + np.uint64(1)), mix(one * np.uint64(3) + mix(two)), mix(two * np.uint64(5) + np.uint64(2))]


def tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes over leaves in their order: each leaf's way (node, child, by depth; -1 beyond it) and the log shares of each node's children."""
    upto = np.concatenate([[0.0], np.cumsum(mass)])
    node_of, child_of, shares = [], [], []
    todo = [(0, len(mass), [])]
    way: list[list[tuple[int, int]]] = [[] for _ in mass]
    for lo, hi, before in todo:  # grows while it is read
        node, at = len(shares), lo
        share = np.full(WIDTH, -1e4, np.float32)
        for child in range(WIDTH):
            left = WIDTH - child
            if at == hi:
                break
            if hi - at <= left:
                end = at + 1
            else:
                want = upto[at] + (upto[hi] - upto[at]) / left
                end = int(min(max(np.searchsorted(upto, want, "right") - 1, at + 1), hi - left + 1)) if left > 1 else hi
            share[child] = np.log((upto[end] - upto[at]) / (upto[hi] - upto[lo]))
            here = [*before, (node, child)]
            if end - at == 1:
                way[at] = here
            else:
                todo.append((at, end, here))
            at = end
        shares.append(share)
    depth = max((len(w) for w in way), default=0)
    node_of, child_of = (np.array([[x[k] for x in w] + [-1] * (depth - len(w)) for w in way], np.int32).reshape(len(way), depth) for k in (0, 1))
    return node_of, child_of, np.array(shares, np.float32).reshape(-1, WIDTH)


@dataclass
class Leaves:
    """Which leaf a word has, and what is known of leaves."""

    head: np.ndarray  # sorted hashes of words with a leaf of their own
    head_leaf: np.ndarray
    head_share: np.ndarray  # log10 of their smoothed counts
    first: np.ndarray  # by last two bytes: the first shared leaf and how many, by hash, there are
    spread: np.ndarray
    norm: np.ndarray  # log10 of a shared leaf's smoothed total, 0 for words' own
    nodes: np.ndarray
    children: np.ndarray
    shares: np.ndarray

    def of(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, and the places in head, or -1."""
        sub = (mix(h + np.uint64(77)) >> np.uint64(40)).astype(np.int64)
        leaf = self.first[tail] + sub % self.spread[tail]
        if not len(self.head):
            return leaf, np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        own = self.head[k] == h
        return np.where(own, self.head_leaf[k], leaf), np.where(own, k, -1)


class Weights:
    def __init__(self, leaves: Leaves, rows: int, values: np.ndarray | None = None):
        self.leaves, self.least = leaves, np.uint64(rows - 1)
        self.w = np.zeros((rows, WIDTH), np.float32) if values is None else values
        self.ones = np.ones(WIDTH, np.float32)

    def levels(self, leaf: np.ndarray, found: list[np.ndarray]):
        """(places, node, child, rows of weights) of each depth."""
        at = np.arange(len(leaf))
        for k in range(self.leaves.nodes.shape[1]):
            node = self.leaves.nodes[leaf[at], k]
            some = node >= 0
            if not some.all():
                at, node = at[some], node[some]
            if not len(at):
                return
            step = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield at, node, self.leaves.children[leaf[at], k], [(mix(f[at] + step) & self.least).astype(np.int64) for f in found]

    def logits(self, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        out = self.leaves.shares.take(node, 0)
        for r in rows:
            out += self.w.take(r, 0)
        return np.minimum(out, 60, out=out)

    def log10(self, leaf: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(leaf))
        for at, node, child, rows in self.levels(leaf, found):
            x = self.logits(node, rows)
            own = x[np.arange(len(at)), child].astype(np.float64)
            total[at] += (own - np.log(np.exp(x, out=x) @ self.ones)) / np.log(10)
        return total

    def step(self, seen: np.ndarray, met: np.ndarray, leaf: np.ndarray, found: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step on a batch of 2**16 places at most. seen: the sums of squares, met: the number of tokens, by row."""
        for at, node, child, rows in self.levels(leaf, found):
            up = self.logits(node, rows)
            np.exp(up, out=up)
            up *= (-1 / (up @ self.ones))[:, None]
            up[np.arange(len(at)), child] += 1
            for r in rows:
                order = np.sort((r << 16) | np.arange(len(r)))
                ranked = order >> 16
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                g = np.add.reduceat(up.take(order & 0xFFFF, 0), first, axis=0)
                which = ranked[first]
                s = seen.take(which) + np.einsum("ij,ij->i", g, g) / WIDTH
                seen[which] = s
                met[which] += np.diff(first, append=len(r))
                g *= (rate / np.sqrt(s))[:, None]
                g += self.w.take(which, 0)
                self.w[which] = g


def _buckets(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes: the buckets that have some, and where each starts and the last ends."""
    of = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(h) else np.zeros(0, np.int64)
    return of[at], np.append(at, len(h))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


VOCABULARY = "bucket long, h binary, tail binary, c binary"


def _count(bits: int):
    """Words and their numbers, added up within blocks of a task and packed by bucket."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            h, first, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            c = np.bincount(back, np.concatenate([x[2] for x in held])).astype(np.uint64)
            tail = np.concatenate([x[1] for x in held])[first].astype(np.uint16)
            held.clear()
            which, at = _buckets(h, bits)
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(which), *(_binary([x[a:b] for a, b in cuts]) for x in (h, tail, c))], ["bucket", "h", "tail", "c"])

        for batch in batches:
            for _, _, h, tail, _ in blocks(batch):
                some, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((some, tail[first], c))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, tail, c = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in (("h", np.uint64), ("tail", np.uint16), ("c", np.uint64)))
    return h, tail, c


def _merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """One row for a bucket: its words, sorted by hash, and their numbers."""
    h, tail, c = _unpacked(group)
    some, first, back = np.unique(h, return_index=True, return_inverse=True)
    total = np.zeros(len(some), np.uint64)
    np.add.at(total, back, c)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), **{k: _binary([x]) for k, x in (("h", some), ("tail", tail[first]), ("c", total))}})


def _packed(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield _unpacked(pa.Table.from_batches([batch.slice(k, 1)]))


def _largest(most: int):
    """The most frequent words of each bucket."""

    def run(batches):
        for h, tail, c in _packed(batches):
            top = np.argsort(-c.astype(np.float64), kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(tail[top].astype(np.int32)), pa.array(c[top].astype(np.int64))], ["h", "tail", "c"])

    return run


def _sums(head: np.ndarray, keys, n: int):
    """(key, c, k): tokens and kinds of the words that aren't in head, by keys(h, tail) under n."""

    def run(batches):
        c_of, k_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for h, tail, c in _packed(batches):
            rest = ~np.isin(h, head, assume_unique=True)
            key = keys(h[rest], tail[rest])
            np.add.at(c_of, key, c[rest].astype(np.int64))
            k_of += np.bincount(key, minlength=n)
        some = np.flatnonzero(k_of)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c_of[some]), pa.array(k_of[some])], ["key", "c", "k"])

    return run


def _train(leaves: Leaves, values: np.ndarray, rate: float):
    def run(batches):
        from pyspark import TaskContext

        rows = len(values)
        work, n = Weights(leaves, rows, values.copy()), 0
        seen, met = np.full(rows, DAMP, np.float32), np.zeros(rows, np.float32)
        for batch in batches:
            for _, _, h, tail, row in blocks(batch):
                leaf, _ = leaves.of(h, tail)
                found = features(leaf, row)
                for a in range(0, len(h), BATCH):
                    work.step(seen, met, leaf[a : a + BATCH], [f[a : a + BATCH] for f in found], rate)
                n += len(h)
        if n:
            pid = TaskContext.get().partitionId()
            for chunk, part in enumerate(np.array_split(np.arange(rows), CHUNKS)):
                some = part[met[part] > 0]
                moved = ((work.w[some] - values[some]) * met[some, None]).astype(np.float32)
                yield _sum_row(chunk, pid, some, met[some], moved / np.maximum(met[some, None], 1))

    return run


SUMS = "chunk long, pid long, rows binary, met binary, moved binary"


def _sum_row(chunk: int, pid: int, rows: np.ndarray, met: np.ndarray, mean: np.ndarray) -> pa.RecordBatch:
    blobs = (rows.astype(np.int32), met.astype(np.float32), mean.astype(np.float16))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pid], pa.int64()), *(_binary([x]) for x in blobs)], ["chunk", "pid", "rows", "met", "moved"])


def _mean(rows: int):
    """Means of the moves of each chunk's rows, whatever the order in which they come."""
    starts = [part[0] for part in np.array_split(np.arange(rows), CHUNKS)] + [rows]

    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "rows", "met", "moved")), strict=True):
                at, met, moved = (np.frombuffer(x, t) for x, t in zip(blobs, (np.int32, np.float32, np.float16), strict=True))
                if chunk not in sums:
                    size = starts[chunk + 1] - starts[chunk]
                    sums[chunk] = np.zeros(size), np.zeros((size, WIDTH))
                at = at - starts[chunk]
                sums[chunk][0][at] += met
                sums[chunk][1][at] += moved.reshape(-1, WIDTH).astype(np.float64) * met[:, None]
        for chunk, (met, moved) in sums.items():
            some = np.flatnonzero(met)
            yield _sum_row(chunk, 0, some + starts[chunk], met[some], moved[some] / met[some, None])

    return run


@dataclass
class Model:
    vocabulary: DataFrame  # VOCABULARY
    bits: int
    leaves: Leaves
    values: np.ndarray
    n: int
    kinds: int


def _size(n: int, per_root: float, bounds: tuple[int, int]) -> int:
    """A power of two in proportion to the root of n."""
    return min(bounds[1], max(bounds[0], 1 << int(np.ceil(np.log2(max(1.0, per_root * n**0.5))))))


def _leaves(vocabulary: DataFrame) -> tuple[Leaves, int, int]:
    """The leaves, and how many tokens and kinds of words there are."""
    none = np.zeros(0, np.uint64)
    by_tail = vocabulary.mapInArrow(_sums(none, lambda h, tail: tail.astype(np.int64), 1 << 16), "key long, c long, k long")
    total = by_tail.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    n, kinds = int(total["c"]), int(total["k"])
    wanted = _size(n, LEAVES_PER_ROOT, LEAVES)
    top = vocabulary.mapInArrow(_largest(wanted // 2), "h long, tail int, c long").orderBy(F.desc("c"), "h").limit(wanted // 2).collect()
    top.sort(key=lambda r: np.int64(r["h"]).view(np.uint64))
    head = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    rest = vocabulary.mapInArrow(_sums(head, lambda h, tail: tail.astype(np.int64), 1 << 16), "key long, c long, k long")
    tails = np.zeros(1 << 16)
    for r in rest.groupBy("key").agg(F.sum("c").alias("c")).collect():  # 65,536 rows at most
        tails[r["key"]] = r["c"]
    # endings in order, dealt so that each shared leaf has about as many tokens: rare ones share a leaf, frequent ones have several by hash
    each = max(1.0, tails.sum() / max(1, wanted // 2))
    spread = np.maximum(1, np.minimum(1 << 12, np.round(tails / each))).astype(np.int64)
    low = spread == 1
    group = np.zeros(1 << 16, np.int64)
    run, filled, number = 0, 0.0, -1
    for t in range(1 << 16):  # neighbours under one share of tokens are one leaf
        if not low[t] or number < 0 or not run or filled + tails[t] > each:
            number += int(spread[t])
            group[t], filled, run = number - int(spread[t]) + 1, tails[t], int(low[t])
        else:
            group[t], filled = number, filled + tails[t]
    shared = number + 1
    cell = lambda h, tail: group[tail] + (mix(h + np.uint64(77)) >> np.uint64(40)).astype(np.int64) % spread[tail]
    cells = vocabulary.mapInArrow(_sums(head, cell, shared), "key long, c long, k long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("k").alias("k")).collect()
    mass = np.full(shared, ALPHA)
    for r in cells:
        mass[r["key"]] += r["c"] + ALPHA * r["k"]
    counts = np.array([r["c"] for r in top], np.float64)
    # leaves in order of their endings, so that classes are words of like endings
    first_tail = np.zeros(shared, np.int64)
    for t in range((1 << 16) - 1, -1, -1):
        first_tail[group[t] : group[t] + spread[t]] = t
    endings = np.concatenate([first_tail, np.array([r["tail"] for r in top], np.int64)])
    masses = np.concatenate([mass, counts + ALPHA])
    order = np.lexsort((-masses, endings))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes, children, shares = tree(masses[order])
    norm = np.concatenate([np.log10(mass), np.zeros(len(top))])
    return Leaves(head, shared + np.arange(len(top)), np.log10(counts + ALPHA), group, spread, norm, nodes[place], children[place], shares), n, kinds


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Learn from every row of ``docs(doc_id, text)``."""
    size = text_bytes(docs)
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / BUCKET_BYTES)))))
    counted = docs.select("text").mapInArrow(_count(bits), VOCABULARY)
    vocabulary = materialise(counted.groupBy("bucket").applyInArrow(_merge, VOCABULARY), "vocabulary")
    leaves, n, kinds = _leaves(vocabulary)
    rows = _size(n, ROWS_PER_ROOT, ROWS)
    values = np.zeros((rows, WIDTH), np.float32)
    tasks = max(1, -(-size // (max(1, rounds) * TASK_BYTES)))
    for k in range(rounds if n else 0):
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)) == k).select("text").coalesce(tasks)
        moves = part.mapInArrow(_train(leaves, values, rate), SUMS)
        partly = moves.repartition("chunk", F.col("pid") % 16).mapInArrow(_mean(rows), SUMS)
        values = values.copy()
        for r in partly.repartition("chunk").mapInArrow(_mean(rows), SUMS).collect():  # one model
            values[np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["moved"], np.float16).reshape(-1, WIDTH)
    return Model(vocabulary, bits, leaves, values, n, kinds)


#: A block's questions have a bucket and hashes; what it knows by itself has neither.
ASKED = "block long, bucket long, h binary, doc_id array<long>, held_out array<boolean>, n array<long>, known array<long>, base array<double>, score array<double>, rest binary, kinds binary"


def _score(model: Model):
    leaves, values, bits = model.leaves, model.values, model.bits

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        work, number = Weights(leaves, len(values), values), TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for lo, hi in slices(at, BLOCK_BYTES):
                size = hi - lo
                n, known, base, score = (np.zeros(size) for _ in range(4))
                rest_h, rest_row = [], []
                for a, b in slices(at[lo : hi + 1], 1 << 20):
                    h, tail, row = words(data, at[lo + a : lo + b + 1])
                    leaf, place = leaves.of(h, tail)
                    found = features(leaf, row)
                    own = place >= 0
                    chance = np.concatenate([work.log10(leaf[x : x + BATCH], [f[x : x + BATCH] for f in found]) for x in range(0, len(h), BATCH)])
                    share = np.where(own, leaves.head_share[place], 0.0) if len(leaves.head) else np.zeros(len(h))
                    for into, v in ((n, None), (known, own), (base, share), (score, chance - leaves.norm[leaf])):
                        into[a:b] = np.bincount(row, v, b - a)
                    rest_h.append(h[~own])
                    rest_row.append(row[~own] + a)
                kinds, which = np.unique(np.concatenate(rest_h), return_inverse=True)
                row = np.concatenate(rest_row)
                which = np.sort(row * max(1, len(kinds)) + which) % max(1, len(kinds))  # by row, the order inside doesn't count
                asked, cuts = _buckets(kinds, bits)
                m, blobs = len(asked), _binary([kinds[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
                few = lambda x, t: pa.array([None] * m + [x], t)
                told = [batch.column("doc_id").slice(lo, size).to_pylist(), batch.column("held_out").slice(lo, size).to_pylist(), n.astype(np.int64), known.astype(np.int64), base, score]
                types = [pa.list_(t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                packed = [pack(np.bincount(row, minlength=size).astype(np.uint32).tobytes()), pack(np.diff(which, prepend=0).astype(np.int32).tobytes())]
                columns = [pa.array([number] * (m + 1), pa.int64()), pa.array([*asked.tolist(), None], pa.int64()), pa.concat_arrays([blobs, pa.nulls(1, pa.binary())])]
                columns += [few(x, t) for x, t in zip(told, types, strict=True)] + [few(x, pa.binary()) for x in packed]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ASKED.split(", ")])
                number += 1

    return run


def _answer(asked: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """The numbers of the words that each block asked a bucket for."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    h, _, c = _unpacked(vocabulary)
    out = []
    for blob in asked.column("h").to_pylist():
        want = np.frombuffer(blob, np.uint64)
        if len(h):
            k = np.minimum(np.searchsorted(h, want), len(h) - 1)
            out.append(np.where(h[k] == want, c[k], np.uint64(0)))
        else:
            out.append(np.zeros(len(want), np.uint64))
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "c": pa.array([pack(x.tobytes()) for x in out], pa.binary())})


def _finish(total: int, kinds: int):
    norm = np.log10(total + ALPHA * (kinds + 1)) if total else 0.0

    def run(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        known_of: dict[int, list[tuple[int, bytes]]] = {}
        for block, bucket, c in zip(*(answers.column(x).to_pylist() for x in ("block", "bucket", "c")), strict=True):
            known_of.setdefault(block, []).append((bucket, c))
        out: list[list] = [[] for _ in range(6)]
        for r in blocks_.to_pylist():
            c = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(unpack(x), np.uint64) for _, x in sorted(known_of.get(r["block"], [])))])
            which = np.cumsum(np.frombuffer(unpack(r["kinds"]), np.int32), dtype=np.int64)
            size = len(r["doc_id"])
            row = np.repeat(np.arange(size), np.frombuffer(unpack(r["rest"]), np.uint32))
            share = np.bincount(row, np.log10(c[which] + ALPHA), size)
            n = np.array(r["n"], np.int64)
            known = np.array(r["known"], np.int64) + np.bincount(row, c[which] > 0, size).astype(np.int64)
            base = np.array(r["base"]) + share - n * norm if total else np.zeros(size)
            score = np.array(r["score"]) + share if total else np.zeros(size)
            for x, v in zip(out, (r["doc_id"], r["held_out"], n.tolist(), known.tolist(), base.tolist(), score.tolist()), strict=True):
                x += v
        doc, held, n, known, base, score = out
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = (doc, held, n, known, [total] * len(n), base, score)
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of ``docs(doc_id, held_out, text)``: tokens, known tokens, the unigram base and the model's log10 probability."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    asked = materialise(rows.mapInArrow(_score(model), ASKED), "asked")
    questions = asked.where("bucket is not null").select("block", "bucket", "h")
    answers = questions.groupBy("bucket").cogroup(model.vocabulary.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, c binary")
    answers = materialise(answers, "answers")
    told = asked.where("bucket is null").drop("bucket", "h")
    return told.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(model.n, model.kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
