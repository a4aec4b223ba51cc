"""Set algebra on arrays and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def algebra(a: Column, b: Column) -> dict[str, Column]:
    """The operations of a set library, on arrays taken as sets."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    none = lambda c: F.size(c) == 0
    return {
        "union": F.array_union(a, b),
        "intersect": F.array_intersect(a, b),
        "except": left,
        "symmetric": F.array_union(left, right),
        "subset": none(left),
        "proper_subset": none(left) & ~none(right),
        "superset": none(right),
        "proper_superset": none(right) & ~none(left),
        "overlaps": F.size(F.array_intersect(a, b)) > 0,
        "equal": none(left) & none(right),
    }


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as it has them more; side says which."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def add(a: Column, x: Column) -> Column:
    return F.array_union(a, F.array(x))


def remove(a: Column, x: Column) -> Column:
    return F.array_remove(F.array_distinct(a), x)


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def clear(a: Column) -> Column:
    return F.filter(a, lambda _: F.lit(False))


def remove_where(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(F.array_distinct(a), lambda x: ~test(x))
