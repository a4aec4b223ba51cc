"""Checks of results: each returns what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.columns import order, sort_key, tokenize
from tagwright.operators.exclude import excluded_ids
from tagwright.operators.paging import ranked
from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL, Sort, TagQuery


#: Places of a list that one task looks at.
STRETCH = 1 << 16


def order_violations(pages: DataFrame, sort: Sort, by: str | None = None) -> DataFrame:
    """Rows of ``pages(pos, ...)`` whose sort value exceeds that of the row before, within each ``by``.

    A list is looked at in stretches of places, each with the last row of the one before, so a long list isn't one task's.
    """
    own = F.floor(F.col("pos") / STRETCH)
    laid = pages.withColumn("_stretch", F.explode(F.array_distinct(F.array(own, F.floor((F.col("pos") + 1) / STRETCH)))))
    w = Window.partitionBy(*([by] if by else []), "_stretch").orderBy("pos")
    told = laid.withColumn("before", F.lag("sort_value").over(w))
    return told.where((F.col("sort_value") > F.col("before")) & (F.col("_stretch") == own)).drop("_stretch")


def numbered(engine: Engine, sort: Sort) -> DataFrame:
    """(tag, pos, id, sort_value): every posting list in its order, with places from 1. One shuffle by ranges of (tag, order), whatever the longest list."""
    rows = engine.post_tags.select("tag", "id", sort.column)
    placed = ranked(rows, [F.col("tag"), *order(sort)], "_rank")
    first = placed.groupBy("tag").agg(F.min("_rank").alias("_first"))
    return placed.join(first, "tag").select("tag", (F.col("_rank") - F.col("_first") + 1).alias("pos"), "id", sort_key(sort).alias("sort_value"))


def list_violations(engine: Engine, sort: Sort) -> DataFrame:
    """Entries of the posting lists that aren't posts of their tag with that sort value."""
    tags = tokenize(F.col("raw_tags"))
    posts = engine.posts.select("id", tags.alias("tags"), sort_key(sort).alias("true_value"))
    lists = engine.post_tags.select("id", "tag", sort_key(sort).alias("value"))
    return lists.join(posts, "id", "left").where(F.coalesce(~F.array_contains("tags", F.col("tag")) | (F.col("value") != F.col("true_value")), F.lit(True)))


def invalid_results(engine: Engine, found: DataFrame, q: TagQuery) -> DataFrame:
    """Found posts that don't satisfy the query's expression."""
    tags = tokenize(F.col("raw_tags"))
    has = lambda t: F.lit(True) if t == ALL else F.array_contains(tags, t)
    a = has(q.tag)
    ok = a if q.other_tag is None else {"AND": a & has(q.other_tag), "AND-NOT": a & ~has(q.other_tag), "OR": a | has(q.other_tag), "OR-NOT": a | ~has(q.other_tag)}[q.operator]
    return engine.posts.join(found.select("id"), "id", "left_semi").where(~ok).select("id", "raw_tags")


def leaks(engine: Engine, found: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Found posts that carry excluded tags, with those tags."""
    bad = F.array_sort(F.array_intersect(tokenize(F.col("raw_tags")), F.array(*(F.lit(t) for t in excluded)).cast("array<string>")))
    return engine.posts.join(found.select("id"), "id", "left_semi").select("id", bad.alias("bad")).where(F.size("bad") > 0)


def exclusion_errors(engine: Engine, tags: Sequence[str]) -> DataFrame:
    """One row: posts excluded without cause, and posts that should be excluded and aren't."""
    listed = F.array(*(F.lit(t) for t in tags)).cast("array<string>")
    should = engine.posts.select("id", F.arrays_overlap(tokenize(F.col("raw_tags")), listed).alias("should"))
    both = should.join(excluded_ids(engine, tags).select("id", F.lit(True).alias("is")), "id", "left")
    is_ = F.coalesce("is", F.lit(False))
    return both.agg(F.count_if(is_ & ~F.col("should")).alias("n_wrong"), F.count_if(~is_ & F.col("should")).alias("n_missed"))
