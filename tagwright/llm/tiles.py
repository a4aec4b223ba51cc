"""Exact links inside groups of rows, computed tile by tile and returned in linear size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tagwright.llm.kernels import trim

LINKS = "node long, other long, links long"


def groups(batches: Iterator[pa.RecordBatch], key: str = "gid") -> Iterator[pa.Table]:
    """The rows of each key, from batches that come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and ids[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = ids[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row of each row's component, given the linked pairs."""
    label = np.arange(m)
    while True:
        new = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def told(node: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list, list, list]:
    """Rows of LINKS: how many rows each node is linked to, and edges that join what hangs together."""
    m = len(node)
    count = np.bincount(i, weight[j], m) + np.bincount(j, weight[i], m)
    some = np.flatnonzero(count)
    root = forest(m, i, j)
    hung = np.flatnonzero(root != np.arange(m))
    return (
        [*node[some].tolist(), *node[hung].tolist()],
        [*[None] * len(some), *node[root[hung]].tolist()],
        [*count[some].astype(np.int64).tolist(), *[0] * len(hung)],
    )


def batched(rows: Iterator[tuple[list, list, list]], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    out: tuple[list, list, list] = ([], [], [])

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "other", "links"])

    for row in rows:
        for x, v in zip(out, row, strict=True):
            x += v
        if len(out[0]) > most:
            yield flush()
            out = ([], [], [])
    yield flush()


def tiled(pairs_of: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """A mapInArrow function over rows (gid, side, node, weight, ...) sorted by gid.

    A gid is a whole group (all rows of side 0) or a pair of tiles (sides 0 and 1), in which only
    pairs across the sides count. pairs_of gets the rows, in order of node, and their sides; it
    returns the linked pairs, each once.
    """

    def run(batches):
        def rows():
            for group in groups(batches):
                node, one = np.unique(group.column("node").to_numpy(), return_index=True)
                if len(node) < 2:
                    continue
                group = group.take(pa.array(one)).combine_chunks()
                i, j = pairs_of(group, group.column("side").to_numpy())
                if len(i):
                    yield told(node, group.column("weight").to_numpy(), i, j)

        yield from batched(rows())
        trim()

    return run
