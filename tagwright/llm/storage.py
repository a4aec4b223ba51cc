"""Materialised intermediates in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor never
takes an intermediate with it. Only on a local master may that setting be unset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tagwright.plans.shared import shared_dir


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tagwright_path = path
    return back


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Inside, no more than so many rows go to a Python worker at once: rows here are whole documents, and the default of 10,000 holds tens of megabytes in each worker and beside it in the JVM. The session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(df: DataFrame) -> None:
    """Delete a materialised table that nothing lazy reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tagwright_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a string column over all rows: what sizes blocks in proportion to the input."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])
