"""A bitmap index: for each tag, bits at its posts' places in a global order, in buckets of 4 KiB."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.functions.columns import order, sort_key
from tagwright.operators.paging import ranked
from tagwright.plans.engine import Engine
from tagwright.plans.query import ALL, Sort, TagQuery
from tagwright.plans.shared import shared_dir
from tagwright.sources.tables import read_table, write_table


@dataclass(frozen=True)
class BitmapIndex:
    """bits(tag, bucket, bits); places(id, rank): the order, from 1; sizes(tag, n): how many bits each tag was given."""

    bits: DataFrame
    places: DataFrame
    sizes: DataFrame

    def save(self, folder: str) -> BitmapIndex:
        spark = self.bits.sparkSession
        write_table(self.places, f"{folder}/places")
        write_table(self.bits.repartitionByRange("tag", "bucket").sortWithinPartitions("tag", "bucket"), f"{folder}/bits")
        write_table(self.sizes, f"{folder}/sizes")
        return self.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BitmapIndex:
        """Raises where a tag's bits aren't as many as were written."""
        index = cls(*(read_table(spark, f"{folder}/{t}") for t in ("bits", "places", "sizes")))
        wrong = mismatches(index.sizes, index.bits).limit(3).collect()
        if wrong:
            raise ValueError(f"bitmaps in {folder} are damaged: {', '.join(f'{r.tag} has {r.bits} bits of {r.n}' for r in wrong)}")
        return index


def places(engine: Engine, sort: Sort) -> DataFrame:
    return ranked(engine.list_of(ALL).select("id", sort.column), order(sort)).select("id", "rank")


def populate(post_tags: DataFrame, where: DataFrame) -> DataFrame:
    """(tag, bucket, bits) of ``post_tags(id, tag)``."""
    return (
        post_tags.select("id", "tag").join(where, "id")
        .groupBy("tag", F.bitmap_bucket_number("rank").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("rank")).alias("bits"))
    )


def build(engine: Engine, sort: Sort) -> BitmapIndex:
    where = places(engine, sort)
    return BitmapIndex(populate(engine.post_tags, where), where, engine.tag_counts)


def index_for(engine: Engine, sort: Sort) -> BitmapIndex:
    """The index, built once for each engine and order, and read from the shared folder."""
    if sort not in engine.kept:
        spark = engine.posts.sparkSession
        engine.kept[sort] = build(engine, sort).save(f"{shared_dir(spark)}/bitmaps-{uuid.uuid4().hex}")
    return engine.kept[sort]


def cardinalities(bits: DataFrame) -> DataFrame:
    return bits.groupBy("tag").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def mismatches(sizes: DataFrame, bits: DataFrame) -> DataFrame:
    """Tags whose bits and posts differ in number."""
    have = cardinalities(bits).withColumnRenamed("n", "bits")
    return sizes.join(have, "tag", "full_outer").where(~F.col("n").eqNullSafe(F.col("bits")))


def union(bits: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(bucket, bits): the posts that have any of the tags, as one bitmap."""
    return bits.where(F.col("tag").isin(list(tags))).groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def is_set(bits: Column, rank: Column) -> Column:
    """Whether a bucket's bitmap has the bit of a place in that bucket; a bitmap that isn't there has none."""
    at = F.bitmap_bit_position(rank)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _roles(index: BitmapIndex, q: TagQuery) -> DataFrame:
    """(bucket, a, b, e): the bitmaps of both tags and of what is excluded, for each bucket of the order."""
    every = index.places.groupBy(F.bitmap_bucket_number("rank").alias("bucket")).agg(F.count("*").alias("n"))
    out = every
    for name, tags in (("a", [q.tag]), ("b", [q.other_tag]), ("e", q.exclusions)):
        out = out.join(union(index.bits, tags).withColumnRenamed("bits", name), "bucket", "left")
    return out


def _chosen(q: TagQuery, a: Column, b: Column, e: Column) -> Column:
    fit = {"AND": a & b, "AND-NOT": a & ~b, "OR": a | b, "OR-NOT": a | ~b}[q.operator]
    return fit & ~e


def pair_counts(index: BitmapIndex, a: str, b: str) -> DataFrame:
    """How many posts each operator of two tags gives: intersections of bitmaps, the rest by counting."""
    both = index.bits.where(F.col("tag").isin(a, b)).groupBy("bucket").agg(F.count("*").alias("k"), F.expr("bitmap_and_agg(bits)").alias("bits"), F.sum(F.when(F.col("tag") == a, F.bitmap_count("bits"))).alias("a"), F.sum(F.when(F.col("tag") == b, F.bitmap_count("bits"))).alias("b"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.agg(zero(F.when(F.col("k") == 2, F.bitmap_count("bits"))).alias("n_and"), zero("a").alias("a"), zero("b").alias("b"))
    n = index.places.agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(n)).select("n_and", (F.col("a") - F.col("n_and")).alias("n_and_not"), (F.col("a") + F.col("b") - F.col("n_and")).alias("n_or"), (F.col("n") - F.col("b") + F.col("n_and")).alias("n_or_not"))  # a row each


def positions(index: BitmapIndex, q: TagQuery) -> DataFrame:
    """(id, rank) of the posts whose bits satisfy the expression, NOT among them, and aren't excluded."""
    at = index.places.withColumn("bucket", F.bitmap_bucket_number("rank"))
    joined = at.join(_roles(index, q), "bucket")
    return joined.where(_chosen(q, *(is_set(F.col(c), F.col("rank")) for c in "abe"))).select("id", "rank")


def page(engine: Engine, index: BitmapIndex, q: TagQuery, sort: Sort) -> DataFrame:
    """(pos, id, sort_value) of a page, from the bitmaps of the query's order: ranks are the order already, so nothing is sorted but the page."""
    engine.check(q)
    some = positions(index, q).orderBy("rank").offset(q.offset).limit(q.page_size)
    placed = some.select("id", (F.row_number().over(Window.orderBy("rank")) + q.offset).cast("long").alias("pos"))  # a page's rows
    return engine.posts.join(F.broadcast(placed), "id").select("pos", "id", sort_key(sort).alias("sort_value"))


def violations(engine: Engine, index: BitmapIndex, sort: Sort) -> DataFrame:
    """(tag, rank, problem): posts whose bit isn't set, tags with bits too many or too few, and places out of order."""
    listed = engine.post_tags.select("id", "tag").join(index.places, "id").withColumn("bucket", F.bitmap_bucket_number("rank"))
    unset = listed.join(index.bits, ["tag", "bucket"], "left").where(~is_set(F.col("bits"), F.col("rank"))).select("tag", "rank", F.lit("unset").alias("problem"))
    count = mismatches(engine.tag_counts, index.bits).select("tag", F.lit(None).cast("long").alias("rank"), F.lit("count").alias("problem"))
    from tagwright.operators.validate import order_violations

    values = index.places.join(engine.posts, "id").select(F.col("rank").alias("pos"), sort_key(sort).alias("sort_value"))
    wrong = order_violations(values, sort).select(F.lit(ALL).alias("tag"), F.col("pos").alias("rank"), F.lit("order").alias("problem"))
    return unset.unionByName(count).unionByName(wrong)
