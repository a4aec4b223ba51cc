"""From raw documents to packed sequences: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. run() writes each stage's result as Parquet in the shared folder and reads it
again as the next one's documents. Rows with null texts or ids pass through every filter
that can't judge them; of repeated rows one stays; other columns, whatever their names, go along to
the last stage, which doesn't return them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import decontaminate, jaccard, packing, quality, secrets
from tagwright.llm.queries import tokenizer
from tagwright.llm.storage import materialise, release

#: Documents whose score is lower are rejected.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier rejects. It learns from the labels of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.remainder("doc_id", 5) != 0)
    return quality.keep(docs, quality.fit(docs, labels), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of copies and near copies."""
    return jaccard.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    found = decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(materialise(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences."""
    return packing.digest(packing.pack(docs, tokenizer()))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secret_scan), ("packing", pack)]

#: Compression, MinHash and tokenisation have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
