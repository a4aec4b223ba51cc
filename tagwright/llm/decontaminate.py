"""Benchmark decontamination: short test items found inside documents of any length.

An item is the set of its five-word shingles (words are runs of letters and digits, lower-cased; an
item of fewer words is one shingle of all its words). A document contains an item if it has the
share ``threshold`` of the item's shingles. The search is one-sided MinHash: the smallest hashes of
an item are a random sample of its shingles, so the share of them that a document has estimates
the containment whatever the document's length, where a Jaccard signature of a long document would
hardly ever meet a short item's. Items are partitioned by size, in doubling steps; a partition has its own
sketch size, larger for longer items, whose candidates cost more to verify, and its own number of hits
that make a candidate: as many as any of its items at the threshold reaches with the probability
``recall``. The smallest items' sketches are whole. Candidates are then verified: all the item's shingles
are counted in the document.

Items are dealt by shingle into broadcasts of at most BROADCAST_ROWS rows, with one look at the documents for each:
documents' shingles are never shuffled before they have met an item's.

DataFrame functions only. Cases: null or empty texts and items without words match nothing; rows
that share a doc_id or an item_id count as one text; equal items are all reported; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.storage import materialise

WORDS = 5
THRESHOLD = 0.8
#: The size up to which sketches are whole, what a sketch grows by in each partition of larger items, and its largest size.
SKETCH = 16
GROWTH = 4
MOST = 48
RECALL = 0.99999
#: Rows of 24 bytes in a broadcast.
BROADCAST_ROWS = 500_000


def words(text: str = "text") -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")


def shingle_hashes(found: Column, width: int) -> Column:
    """Hashes of every ``width`` successive words of an array."""
    last = F.size(found) - width
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(width), *(F.get(found, i + k) for k in range(width))))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def hits_needed(n: int, sketch: int, threshold: float, recall: float) -> int:
    """The most hits that an item of n shingles, at the threshold, reaches with the probability ``recall`` in a sample of ``sketch`` of them."""
    inside = ceil(threshold * n - 1e-9)
    if sketch >= n:
        return max(1, inside)
    missed, hits = 0.0, 0
    while hits < sketch:
        missed += comb(inside, hits) * comb(n - inside, sketch - hits) / comb(n, sketch)
        if missed > 1 - recall:
            break
        hits += 1
    return max(1, hits)


def partitions(largest: int, threshold: float = THRESHOLD, sketch: int = SKETCH, recall: float = RECALL) -> list[tuple[int, int, int]]:
    """(most shingles, sketch size, hits that make a candidate) of each partition of items above ``sketch`` shingles."""
    out, low, size = [], sketch, sketch
    while low < largest:
        size = min(size + GROWTH, MOST)
        # sizes in between lie between the ends, but for the rounding of the threshold's share
        sizes = sorted({n for base in (low + 1, 2 * low) for n in range(max(low + 1, base - 5), min(2 * low, base + 5) + 1)})
        out.append((2 * low, size, min(hits_needed(n, size, threshold, recall) for n in sizes)))
        low *= 2
    return out


def sketches(items: DataFrame, threshold: float, sketch: int, recall: float) -> DataFrame:
    """(item_id, width, n, h, is_min, needed): every shingle of every item; is_min marks its sketch."""
    own = F.filter(words(), lambda w: w != "")
    cut = items.select("item_id", own.alias("w")).where(F.size("w") > 0)
    hashes = F.coalesce(*(F.when(F.size("w") == k, shingle_hashes(F.col("w"), k)) for k in range(1, WORDS)), shingle_hashes(F.col("w"), WORDS))
    each = cut.select("item_id", F.least(F.size("w"), F.lit(WORDS)).alias("width"), F.explode(hashes).alias("h")).distinct()
    sets = materialise(each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("h", "width"))).alias("s")).withColumn("n", F.size("s")), "item-sets")
    size, needed = F.col("n"), F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - 1e-9))  # whole sketches
    largest = sets.agg(F.max("n")).first()[0] or 0
    for most, k, hits in reversed(partitions(largest, threshold, sketch, recall)):
        inside = (F.col("n") > most // 2) & (F.col("n") <= most)
        size, needed = F.when(inside, k).otherwise(size), F.when(inside, hits).otherwise(needed)
    parts = sets.select("item_id", F.col("n").cast("long").alias("n"), size.alias("size"), needed.cast("long").alias("needed"), F.posexplode("s").alias("k", "x"))
    return parts.select("item_id", F.col("x.width").alias("width"), "n", F.col("x.h").alias("h"), (F.col("k") < F.col("size")).alias("is_min"), "needed")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, sketch: int = SKETCH, recall: float = RECALL, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each item of ``items(item_id, text)`` that a document of ``docs(doc_id, text)`` contains."""
    table = materialise(sketches(items, threshold, sketch, recall), "items")
    widths = [r["width"] for r in table.select("width").distinct().orderBy("width").collect()] or [WORDS]  # 1 to 5

    def met(some: DataFrame, rows: DataFrame) -> DataFrame:
        """(doc_id, h, ...) of the rows whose shingle a document has, once for each document."""
        cut = some.select("doc_id", words().alias("w"))
        spread = cut.select("doc_id", F.explode(F.concat(*(shingle_hashes(F.col("w"), k) for k in widths))).alias("h"))
        deals = max(1, -(-rows.count() // broadcast_rows))
        found = [spread.join(F.broadcast(rows.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(deals)) == k)), "h") for k in range(deals)]
        return reduce(DataFrame.unionByName, found).distinct()

    mins = table.where("is_min").select("h", "item_id", "needed")
    hits = met(docs, mins).groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.first("needed").alias("needed"))
    candidates = materialise(hits.where(F.col("hits") >= F.col("needed")).select("doc_id", "item_id"), "candidates")

    wanted = materialise(table.join(candidates.select("item_id").distinct(), "item_id", "left_semi").select("h", "item_id", "n"), "wanted")
    again = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = met(again, wanted).join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id").agg(F.first("n").alias("n_item"), F.count("*").alias("n_shared"))
    return counted.where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


#: The same rows by exact counting.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
     c AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
     t AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM c)),
     s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM c) ON k <= len(w))),
     n AS (SELECT item_id, count(*) AS n_item FROM t GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN t USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""
