"""The folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only on a local master may it be unset: then a folder of this machine is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tagwright-"))
    return _local[0]


def local_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A short table of the driver's, part of the plan itself. schema: names and types, long or string."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [pa.array([r[k] for r in rows], types[kind]) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.table(columns, names=list(names)))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as it is read back from the shared folder: later plans see the same rows in the same places."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
