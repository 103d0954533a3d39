"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are left out."""
    return spark.read.schema(schema).json(path).dropna(how="all")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
