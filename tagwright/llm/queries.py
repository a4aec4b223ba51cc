"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm import decontaminate, embeddings, jaccard


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagwright.llm import packing

    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), tokenizer()))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagwright.llm import language, quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (quality.remainder("doc_id", 4) == 2).alias("held_out"))
    return language.predict(docs, language.learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagwright.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(quality.remainder("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels), "score")
    return scored.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagwright.llm import secrets

    return secrets.report(_table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near(_table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagwright.llm import html

    return html.extract(_table(spark, sf_dir, "pages"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagwright.llm import urls

    return urls.judge(_table(spark, sf_dir, "pages"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tagwright.llm import maxent, quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (quality.remainder("doc_id", 10) == 0).alias("held_out"))
    return maxent.score(docs, maxent.fit(docs.where(~F.col("held_out"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_urls, op3_maxent, op4_decontaminate, op5_html, op6_embeddings, op7_language, op8_quality, op9_jaccard_join, op10_secrets)}

SQL: dict[str, str] = {"op4_decontaminate": decontaminate.SQL, "op6_embeddings": embeddings.SQL, "op9_jaccard_join": jaccard.SQL}
