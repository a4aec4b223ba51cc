"""Connected components by star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.storage import materialise, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a long, b long)`` is joined to.

    Each round links a node's larger neighbours to the least node around it and then its smaller
    ones (the large star and small star of the known algorithm), so paths shorten by about half;
    it ends when a round changes nothing. A round is two minima and two joins with them: no
    neighbourhood is gathered in one task. Minima and edges are written to the shared folder, so
    that a join with a hub's edges can be split or broadcast by its size.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        release(least)
        release(now)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(least)
        release(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
