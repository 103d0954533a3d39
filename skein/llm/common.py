"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.lineage import cut

__all__ = ["SPACE", "WORD", "cut", "let", "pack", "read", "unpack"]

#: White space and its complement, as the contracts of the quality rules fix them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack(df: DataFrame, **more: Column) -> DataFrame:
    """All columns in one struct ``_row``, beside ``more``; so no name of ``df`` can clash with a helper's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(v.alias(k) for k, v in more.items()))


def unpack(df: DataFrame, columns: list[str], new: dict[str, Column], *more: Column) -> DataFrame:
    """``columns`` out of ``_row`` again, those in ``new`` as given there, and then ``more``."""
    return df.select(*((new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in columns), *more)
