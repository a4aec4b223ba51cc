"""Mixture-controlled packing of documents into token sequences.

Each source with a token a window or more, or with a weight, is a queue of its documents' tokens; rarer
sources, which no window could hold in proportion, wait in queues that they share by hash. Deficit
round-robin serves the queues: a mixture
window takes from every queue its share of the window, and the fraction of a token by which a
queue fell short is carried to its next windows. Served this way, what a queue has sent after
``j`` windows is ``floor(j * tokens / windows)``, so every document can work out where its tokens go
from the queue totals alone: no task replays the rounds, and deficits cross windows and
partitions by arithmetic instead of by state.

The windows' tokens, laid end to end, are cut into sequences of ``length``. Only the last
sequence may be short. Cases: a null text is empty, and a document without text still has its
closing id; a null source is the source ""; repeated documents are packed each time they
come; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from operator import floordiv, mod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.llm.bpe import drop_encoders, encoder
from tagwright.llm.kernels import buffers, slices, trim
from tagwright.llm.storage import materialise, release, small_batches

LENGTH = 1024
WINDOW = 64 * LENGTH
#: Queues that rare sources share.
POOLS = 1024

#: Distinct pieces of text whose ids a Python worker remembers.
SLOTS = 1 << 18

PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, window_id long, ids binary"


class Schedule:
    """Which queue's tokens come when. Phases: with given weights, a queue that runs dry leaves its share to the others."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW):
        self.queues = {q: k for k, q in enumerate(sorted(totals))}
        left = [totals[q] for q in self.queues]
        share = [float((weights or {}).get(q, 0)) if weights else float(totals[q]) for q in self.queues]
        self.phases: list[tuple[int, int, list[int], int, list[int]]] = []  # first position, first window, taken from each, windows, taken before
        at = first = 0
        done = [0] * len(left)
        while any(left):
            live = [k for k, n in enumerate(left) if n]
            if not any(share[k] > 0 for k in live):
                share = [float(n) for n in left]  # what no weight asks for comes last, in proportion
            live = [k for k in live if share[k] > 0]
            until = min(left[k] / share[k] for k in live)
            take = [0] * len(left)
            for k in live:
                take[k] = left[k] if left[k] / share[k] <= until * (1 + 1e-12) else min(left[k], int(share[k] * until))
            size = sum(take)
            windows = max(1, round(size / window))
            self.phases.append((at, first, take, windows, done))
            at, first = at + size, first + windows
            left, done = [a - b for a, b in zip(left, take, strict=True)], [a + b for a, b in zip(done, take, strict=True)]
        self.starts = [p[0] for p in self.phases]
        self._upto = [[p[4][k] + p[2][k] for p in self.phases] for k in range(len(left))]
        kind = lambda windows: np.int64 if windows < 1 << 31 else object  # noqa: E731  (products of two numbers of windows)
        self._shares = [tuple(np.array([f(n, p[3]) for n in p[2]], kind(p[3])) for f in (floordiv, mod)) for p in self.phases]
        self._seen: dict[tuple[int, int], np.ndarray] = {}

    def _layout(self, phase: int, j: int) -> np.ndarray:
        if len(self._seen) > 256:
            self._seen.clear()
        if (phase, j) not in self._seen:
            self._seen[phase, j] = self._laid(phase, j)
        return self._seen[phase, j]

    def _laid(self, phase: int, j: int) -> np.ndarray:
        """Where each queue's part of window j starts."""
        at, _, take, windows, _ = self.phases[phase]
        whole, rest = self._shares[phase]
        # n * j // windows without the long product: n = whole * windows + rest
        before, after = whole * j + rest * j // windows, whole * (j + 1) + rest * (j + 1) // windows
        size = after - before
        return at + int(before.sum()) + np.cumsum(size) - size

    def cut(self, queue: str, a: int, b: int):
        """(position, from, to, window) of each stretch of the queue's tokens a to b."""
        k = self.queues[queue]
        phase = bisect_right(self._upto[k], a)
        while a < b:
            _, first, take, windows, done = self.phases[phase]
            n, i, stop = take[k], a - done[k], min(b, self._upto[k][phase]) - done[k]
            while i < stop:
                j = ((i + 1) * windows - 1) // n
                end = min(stop, n * (j + 1) // windows)
                yield int(self._layout(phase, j)[k]) + i - n * j // windows, i + done[k], end + done[k], first + j
                i = end
            a = stop + done[k]
            phase += 1


def _tokenise(path: str):
    def run(batches):
        work, sent, pid = encoder(path, SLOTS), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            column, queues = batch.column("text"), batch.column("queue").to_pylist()
            for lo, hi in slices(buffers(column)[1], 1 << 19):
                ids, counts = work.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                n = counts + 1
                flat = np.zeros(len(ids) + hi - lo, np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), counts)] = ids
                ats = []
                for q, size in zip(queues[lo:hi], n.tolist(), strict=True):
                    ats.append(sent[q])
                    sent[q] += size
                ends = np.concatenate([[0], np.cumsum(n)]) * 4
                ids = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, pid, np.int64)), batch.column("doc_id").slice(lo, hi - lo), batch.column("source").slice(lo, hi - lo), pa.array(queues[lo:hi], pa.string()), pa.array(n), pa.array(ats, pa.int64()), ids], ["pid", "doc_id", "source", "queue", "n", "at", "ids"])
            trim()

    return run


def _place(schedule: Schedule, length: int):
    names = [x.split()[0] for x in PIECES.split(", ")][:-1]  # the ids come last

    def run(batches):
        drop_encoders()
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "n", "at", "base")]
            data, ends = buffers(batch.column("ids"))
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for doc, source, queue, n, at, base in zip(*(c[lo : lo + 256] for c in cols), strict=True):
                    zero = base + at
                    for pos, a, b, window in schedule.cut(queue, zero, zero + n):
                        while a < b:
                            size = min(b - a, length - pos % length)
                            for x, v in zip(out, (doc, source, a - zero, size, n, pos // length, pos % length, window), strict=True):
                                x.append(v)
                            a, pos = a + size, pos + size
                # a document's pieces come in order and without gaps, so their ids are the batch's own bytes with new offsets
                # (no views of Python objects: pa.array keeps what a memoryview shows for as long as the worker lives)
                bounds = np.concatenate([[0], np.cumsum(out[names.index("length")])]).astype(np.int64) * 4
                held = pa.py_buffer(data[ends[lo] : ends[min(lo + 256, batch.num_rows)]])
                ids = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), held]).cast(pa.binary())
                told = [pa.array(x, pa.string() if c == "source" else pa.int64()) for c, x in zip(names, out, strict=True)]
                yield pa.RecordBatch.from_arrays([*told, ids], [*names, "ids"])
            trim()

    return run


def dealt(docs: DataFrame, weights: dict[str, float] | None, window: int, pools: int = POOLS) -> DataFrame:
    """(doc_id, text, source, queue). A source has a queue of its own if it has a weight or a share of all text of one token a window or more; the others share queues."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source"), F.lit("")).alias("source"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")
    sizes = materialise(rows.groupBy("source").agg(size), "sources")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    own = sizes.where((F.col("size") * window >= total) | F.col("source").isin(list(weights or {}))).select("source", F.concat(F.lit("s:"), "source").alias("queue"))
    shared = F.concat(F.lit("pool:"), F.pmod(F.xxhash64("source"), F.lit(pools)).cast("string"))
    # as many rows as a window has tokens, and the weights
    return rows.join(F.broadcast(own), "source", "left").select("doc_id", "text", "source", F.coalesce("queue", shared).alias("queue"))


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, pools: int = POOLS) -> DataFrame:
    """Pack ``docs(doc_id, text, source)``; one row per piece of a document, with the piece's ids as little-endian 32-bit integers.

    weights: target proportions by source; without them each source's share of all tokens, so
    that every window mirrors the corpus. A source without a weight comes when the others are done.
    The texts are tokenised once, into the shared folder; placing them reads that table and,
    broadcast only where its size on disk allows, each partition's start in its queues.
    """
    spark = docs.sparkSession
    rows = dealt(docs, weights, window, pools)
    with small_batches(spark):
        tokens = materialise(rows.mapInArrow(_tokenise(tokenizer), "pid long, doc_id long, source string, queue string, n long, at long, ids binary"), "tokens", compression="zstd")
    sizes = materialise(tokens.groupBy("queue", "pid").agg(F.sum("n").alias("size")), "sizes")
    totals = {r["queue"]: r["n"] for r in sizes.groupBy("queue").agg(F.sum("size").alias("n")).collect()}  # a window's tokens, weights and pools at most
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sizes.select("queue", "pid", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    release(sizes)
    schedule = Schedule(totals, {f"s:{q}": w for q, w in (weights or {}).items()}, window)
    placed = tokens.join(bases, ["queue", "pid"]).select("doc_id", "source", "queue", "n", "at", "base", "ids")
    return placed.mapInArrow(_place(schedule, length), PIECES) if totals else spark.createDataFrame([], PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences' ids: one row per sequence, its pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    got = pieces.groupBy("sequence_id").agg(parts.alias("pieces"))
    return got.select("sequence_id", "pieces", F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """Checksums in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window_id")
