"""Reading and writing of the operators' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text, empty as null, blank lines skipped; quotes double themselves and may hold breaks."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names).select(*[F.expr(f"nullif(trim(`{c}`), '')").alias(c) for c in names])
    return df.dropna(how="all")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
