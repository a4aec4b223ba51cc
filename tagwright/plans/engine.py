"""The engine: posts, posting lists and the tag dictionary, built once and read by every query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.columns import tokenize
from tagwright.plans.query import ALL, TagQuery
from tagwright.plans.shared import shared_dir
from tagwright.sources.tables import order_posts, read_table, tag_rows, write_table


@dataclass
class Engine:
    posts: DataFrame
    post_tags: DataFrame
    tag_counts: DataFrame
    _sizes: dict[str, int] = field(default_factory=dict, repr=False)
    #: Indexes made from these tables, by what they are of.
    kept: dict = field(default_factory=dict, repr=False)
    #: What was said while the tables were written and read.
    messages: list[str] = field(default_factory=list, repr=False)

    @classmethod
    def from_posts(cls, posts: DataFrame) -> Engine:
        tags = tag_rows(posts)
        return cls(posts, tags, tags.groupBy("tag").agg(F.count("*").alias("n")))

    def save(self, folder: str) -> Engine:
        """Write the tables and return an engine on what was written. Posting lists are dealt by (tag, id), so that a frequent tag spreads over files and a rare one is found by its row group's range."""
        write_table(self.posts, f"{folder}/posts")
        spark = self.posts.sparkSession
        posts = read_table(spark, f"{folder}/posts")
        write_table(tag_rows(posts).repartitionByRange(F.col("tag"), F.col("id")).sortWithinPartitions("tag", "id"), f"{folder}/post_tags")
        tags = read_table(spark, f"{folder}/post_tags")
        write_table(tags.groupBy("tag").agg(F.count("*").alias("n")).coalesce(1), f"{folder}/tag_counts")
        return self.load(spark, folder).verify()

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Engine:
        engine = cls(*(read_table(spark, f"{folder}/{t}") for t in ("posts", "post_tags", "tag_counts")))
        engine.messages.append(f"read {folder}")
        return engine

    def verify(self) -> Engine:
        """Raises unless posts, posting lists and dictionary, as they are read, have the same postings."""
        asked = self.posts.agg(F.count("*").alias("posts"), F.sum(F.size(F.array_distinct(tokenize(F.col("raw_tags"))))).alias("n")).first()
        listed, counted = self.post_tags.agg(F.count("*").alias("n")).first()["n"], self.tag_counts.agg(F.count("*").alias("tags"), F.sum("n").alias("n")).first()
        if not (asked["n"] or 0) == listed == (counted["n"] or 0):
            raise ValueError(f"posts have {asked['n']} tags, posting lists {listed}, the dictionary {counted['n']}")
        self.messages.append(f"{asked['posts']} posts, {counted['tags']} tags, {listed} postings")
        return self

    def list_of(self, tag: str) -> DataFrame:
        """The posts of a tag, with their sort columns; of the pseudo-tag, all posts."""
        if tag == ALL:
            return self.posts.select("id", "last_activity_date", "creation_date", "score", "view_count", "answer_count")
        return self.post_tags.where(F.col("tag") == tag).drop("tag")

    def size(self, tag: str) -> int:
        """How many posts a tag has, from the dictionary."""
        if tag not in self._sizes:
            some = self.posts.agg(F.count("*").alias("n")) if tag == ALL else self.tag_counts.where(F.col("tag") == tag).select("n")
            row = some.first()
            self._sizes[tag] = row["n"] if row else 0
        return self._sizes[tag]

    def check(self, query: TagQuery) -> TagQuery:
        """Raises for a tag that no post has."""
        for tag in (query.tag, query.other_tag):
            if tag is not None and tag != ALL:
                if not self.size(tag):
                    raise ValueError(f"no post has the tag {tag!r}")
        return query


_built: dict[tuple[str, str], Engine] = {}


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the posts made of a folder's orders; its tables are written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        name = "".join(c if c.isalnum() else "-" for c in sf_dir)
        _built[key] = Engine.from_posts(order_posts(spark, sf_dir)).save(f"{shared_dir(spark)}/engine-{spark.sparkContext.applicationId}{name}")
    return _built[key]
