"""Where posts come from and go to."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions.columns import tokenize

POSTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("raw_tags", T.StringType()),
        T.StructField("creation_date", T.TimestampNTZType()),
        T.StructField("last_activity_date", T.TimestampNTZType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("view_count", T.IntegerType()),
        T.StructField("answer_count", T.IntegerType()),
        T.StructField("accepted_answer_id", T.IntegerType()),
    ]
)

#: Attributes of a dump's rows, by column of POSTS.
ATTRIBUTES = {"id": "_Id", "title": "_Title", "raw_tags": "_Tags", "creation_date": "_CreationDate", "last_activity_date": "_LastActivityDate", "score": "_Score", "view_count": "_ViewCount", "answer_count": "_AnswerCount", "accepted_answer_id": "_AcceptedAnswerId"}


def read_dump(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    """Questions (post type 1) of an XML dump. Empty numbers are null; a number that isn't one fails the read."""
    text = T.StructType([T.StructField(a, T.StringType()) for a in ["_PostTypeId", *ATTRIBUTES.values()]])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(text).load(path).where(F.col("_PostTypeId") == "1")
    kinds = {f.name: f.dataType for f in POSTS.fields}

    def parsed(name: str):
        c = F.col(ATTRIBUTES[name])
        return (c if isinstance(kinds[name], T.StringType) else F.nullif(c, F.lit("")).cast(kinds[name])).alias(name)

    return rows.select(*(parsed(n) for n in ATTRIBUTES))


def write_table(df: DataFrame, path: str) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """One tag or wildcard a line; blank lines and repeats dropped. A list kept by hand, which queries carry in their plan."""
    rows = spark.read.text(path).select(F.trim("value").alias("p")).where("p <> ''").distinct().orderBy("p")
    return [r["p"] for r in rows.collect()]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(rows: Iterable[dict], path: str) -> None:
    """Bench results: a header and a line for each row."""
    import csv

    rows = list(rows)
    with Path(path).open("w", newline="") as f:
        w = csv.DictWriter(f, list(rows[0]) if rows else [])
        w.writeheader()
        w.writerows(rows)


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts made of orders: an order is a question, the parts of its line items supply the tags."""
    orders, lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    named = parts.select("p_partkey", F.array_union(F.split(F.lower("p_name"), " "), F.array(F.lower("p_brand"), F.lower("p_type"))).alias("tags"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    sums = (
        lines.join(named, lines["l_partkey"] == named["p_partkey"], "left")
        .groupBy("l_orderkey")
        .agg(
            F.max("l_shipdate").alias("shipped"),
            F.sum(signed).cast("int").alias("score"),
            F.count("*").cast("int").alias("answer_count"),
            F.min(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).cast("int").alias("accepted_answer_id"),
            F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
        )
    )
    own = F.array(F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("-"))))
    tags = F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), own))
    return orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("<"), F.array_join(tags, "><"), F.lit(">")).alias("raw_tags"),
        F.col("o_orderdate").alias("creation_date"),
        F.coalesce("shipped", "o_orderdate").alias("last_activity_date"),
        "score",
        F.floor("o_totalprice").cast("int").alias("view_count"),
        "answer_count",
        "accepted_answer_id",
    )


def tag_rows(posts: DataFrame) -> DataFrame:
    """One row per post and tag, with what posts are ordered by: a posting list that needs no join to be paged."""
    tags = F.explode(F.array_distinct(tokenize(F.col("raw_tags")))).alias("tag")
    return posts.select("id", tags, "last_activity_date", "creation_date", "score", "view_count", "answer_count")
