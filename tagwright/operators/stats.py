"""Statistics of posts and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL


def tag_totals(engine: Engine) -> DataFrame:
    """(tag, n) by falling n, with the pseudo-tag's row for all posts."""
    total = engine.posts.agg(F.count("*").alias("n")).select(F.lit(ALL).alias("tag"), "n")
    return engine.tag_counts.unionByName(total).orderBy(F.desc("n"), "tag")


def total(engine: Engine, tag: str) -> DataFrame:
    return engine.list_of(tag).agg(F.count("*").alias("n")).select(F.lit(tag).alias("tag"), "n")


def tags_over(engine: Engine, n: int) -> DataFrame:
    return engine.tag_counts.where(F.col("n") > n).orderBy(F.desc("n"), "tag")


def extreme_tags(engine: Engine, k: int = 50, most: bool = True) -> DataFrame:
    return engine.tag_counts.orderBy(F.desc("n") if most else F.asc("n"), "tag").limit(k)


def summary(engine: Engine) -> DataFrame:
    """Least, greatest and missing values of what posts are ordered by."""
    both = [f(c).alias(f"{n}_{c}") for c in ("creation_date", "last_activity_date", "score", "view_count", "answer_count") for n, f in (("min", F.min), ("max", F.max))]
    return engine.posts.agg(F.count("*").alias("n_posts"), *both, *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("score", "view_count", "answer_count")))


def extremes(engine: Engine) -> DataFrame:
    """The posts with most views, answers and score; of equals the one with the smallest id. Posts without a value don't count."""
    best = lambda c: F.max_by("id", F.when(F.col(c).isNotNull(), F.struct(c, -F.col("id")))).alias(f"most_{c}")
    return engine.posts.agg(*(best(c) for c in ("view_count", "answer_count", "score")))


def bucket(n):
    """Up to 10 the number itself, then steps of a tenth of the next power of ten, up to a million."""
    steps = [(n < 10 ** (k + 1), (F.floor(n / 10**k) * 10**k + 10**k).cast("long")) for k in range(1, 6)]
    return F.when(n <= 10, n).otherwise(reduce(lambda rest, s: F.when(s[0], s[1]).otherwise(rest), reversed(steps), n))


def histogram(engine: Engine) -> DataFrame:
    """(bucket, n_tags, up_to, from_on): tags by how many posts they have, with running totals both ways."""
    sizes = engine.tag_counts.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_tags"))
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 64 buckets at most
    down = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("bucket", "n_tags", F.sum("n_tags").over(up).alias("up_to"), F.sum("n_tags").over(down).alias("from_on"))


def gram_totals(engine: Engine) -> DataFrame:
    from tagwright.operators.wildcard import gram_index

    return gram_index(engine).agg(F.count_distinct("gram").alias("n_grams"), F.count("*").alias("n_postings"))


def remaining_tags(engine: Engine, excluded) -> DataFrame:
    return engine.tag_counts.join(excluded, "tag", "left_anti").select("tag")
