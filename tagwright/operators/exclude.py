"""Exclusion of posts by tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.columns import fnv1a_hash, tokenize, wang_hash
from tagwright.plans.engine import Engine
from tagwright.plans.shared import local_table


#: Names in an expression; the list's own ranges in the files are skipped by it.
LISTED = 100


def excluded_ids(engine: Engine, tags: Sequence[str]) -> DataFrame:
    """Posts that carry any of the tags; read from their posting lists. A long list is a table, not an expression."""
    if len(tags) <= LISTED:
        return engine.post_tags.where(F.col("tag").isin(list(tags))).select("id").distinct()
    listed = local_table(engine.posts.sparkSession, "tag string", [(t,) for t in dict.fromkeys(tags)])
    return engine.post_tags.join(F.broadcast(listed), "tag", "left_semi").select("id").distinct()  # as long as a query is


def without(engine: Engine, rows: DataFrame, tags: Sequence[str]) -> DataFrame:
    return rows.join(excluded_ids(engine, tags), "id", "left_anti") if tags else rows


def without_bloom(engine: Engine, rows: DataFrame, tags: Sequence[str], bits: int = 100_000_000) -> DataFrame:
    """As ``without``, by a Bloom filter of two hashes: approximate, it may drop posts too many, never too few.

    The filter is the set of its set bits, so it is joined, not broadcast.
    """
    places = lambda: F.array(wang_hash(F.col("id")) % bits, fnv1a_hash(F.col("id")) % bits)
    set_ = excluded_ids(engine, tags).select(F.explode(places()).alias("bit")).distinct()
    own = rows.select("id", F.explode(F.array_distinct(places())).alias("bit"))
    clear = own.join(set_, "bit", "left_anti").select("id").distinct()
    return rows.join(clear, "id", "left_semi")


def coverage(engine: Engine, tags: Sequence[str]) -> DataFrame:
    """How many posts and tags an exclusion list takes and leaves."""
    listed = F.array(*(F.lit(t) for t in tags)).cast("array<string>")
    posts = engine.posts.agg(F.count("*").alias("n_posts"), F.count_if(F.arrays_overlap(tokenize(F.col("raw_tags")), listed)).alias("n_excluded"))
    known = engine.tag_counts.agg(F.count("*").alias("n_tags"), F.count_if(F.array_contains(listed, F.col("tag"))).alias("n_listed"))
    return posts.join(F.broadcast(known), F.lit(True)).select("n_posts", "n_excluded", (F.col("n_posts") - F.col("n_excluded")).alias("n_included"), "n_listed", (F.col("n_tags") - F.col("n_listed")).alias("n_remaining"))  # a row each


def pattern_coverage(engine: Engine, patterns: Sequence[str]) -> DataFrame:
    """As ``coverage``, of a list with wildcards: also how many patterns and wildcards it has, and how many tags they expand to."""
    from tagwright.functions.patterns import is_wildcard
    from tagwright.operators.wildcard import expand

    listed = list(dict.fromkeys(patterns))
    tags = expand(engine, listed)
    out = engine.post_tags.join(tags, "tag", "left_semi").agg(F.count_distinct("id").alias("n_excluded"))
    n = F.broadcast(tags.agg(F.count("*").alias("n_expanded")))
    known = F.broadcast(engine.tag_counts.agg(F.count("*").alias("n_tags")))
    posts = F.broadcast(engine.posts.agg(F.count("*").alias("n_posts")))
    row = out.join(n, F.lit(True)).join(known, F.lit(True)).join(posts, F.lit(True))  # a row each
    fixed = [F.lit(k).cast("long").alias(name) for name, k in (("n_patterns", len(listed)), ("n_wildcards", sum(map(is_wildcard, listed))))]
    return row.select(*fixed, "n_expanded", "n_posts", "n_excluded", (F.col("n_posts") - F.col("n_excluded")).alias("n_included"), (F.col("n_tags") - F.col("n_expanded")).alias("n_remaining"))
