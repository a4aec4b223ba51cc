"""Ordered pages, global ranks, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.columns import order, sort_key
from tagwright.plans.engine import Engine
from tagwright.plans.query import Sort, TagQuery
from tagwright.plans.shared import written


def page(rows: DataFrame, sort: Sort, skip: int, size: int) -> DataFrame:
    """(pos, id, sort_value): one top-k, then positions on the page's rows alone."""
    some = rows.orderBy(*order(sort)).offset(max(0, skip)).limit(size)
    pos = (F.row_number().over(Window.orderBy(*order(sort))) + max(0, skip)).cast("long")  # a page's rows
    return some.select(pos.alias("pos"), "id", sort_key(sort).alias("sort_value"))


def tag_page(engine: Engine, query: TagQuery) -> DataFrame:
    """A page of one tag's posts, without those that carry an excluded tag."""
    from tagwright.operators.exclude import without

    engine.check(query)
    return page(without(engine, engine.list_of(query.tag), query.exclusions), query.sort, query.offset, query.page_size)


def fetch(engine: Engine, found: DataFrame) -> DataFrame:
    """The whole posts of a page: columns are read for its rows only."""
    return engine.posts.join(F.broadcast(found.select("pos", "id")), "id")  # a page has 250 rows at most


def lookup(engine: Engine, id_: int) -> DataFrame:
    return engine.posts.where(F.col("id") == id_).limit(1)


def ranked(rows: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in an order over all of them.

    Rows are dealt into ranges of the order, sorted and numbered there and written once; a range's start is
    the sum of the sizes before it. One shuffle, and no task sees more than its range, as it would with a
    window over everything. Ranges are fixed by what is written: a plan that dealt the rows anew for the sizes
    could deal them otherwise.
    """
    at = f"_at_{uuid.uuid4().hex[:8]}"
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias(at)), "ranked")
    range_, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per range
    joined = dealt.join(F.broadcast(starts), range_ == F.col("_range"))
    return joined.withColumn(name, (F.col("_before") + place + 1).cast("long")).drop(at, "_range", "_before")


def top_views(engine: Engine, n: int = 100) -> DataFrame:
    """The most viewed posts; here posts without a number come last."""
    by = [F.col("view_count").desc_nulls_last(), F.col("id").desc()]
    some = engine.posts.orderBy(*by).limit(n)
    return some.select(F.row_number().over(Window.orderBy(*by)).cast("long").alias("pos"), "id", F.col("view_count").cast("long").alias("view_count"))


def sample(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    """Every k-th row of an order, n at most, with k = rows / n; all rows if there are fewer."""
    total = rows.count()
    step = max(1, total // max(1, n))
    at = ranked(rows, by, "_rank").where((F.col("_rank") - 1) % step == 0).orderBy("_rank").limit(max(0, n))
    return at.drop("_rank")
