"""Cutting lineage into storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one where it is unset (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(_LOCAL[context.applicationId])
    return _LOCAL[context.applicationId]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    The files outlive lost executors. They stay until the folder is cleared, as the returned frame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the rounds of an iterative job."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
