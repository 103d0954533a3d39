"""Bounded samples that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 40
#: Bytes of the longest text that a model is fitted on; so a sample of n texts has at most n times as many.
SAMPLE_BYTES = 1 << 15


def fits(text: str | Column) -> Column:
    """Whether a text is short enough for a sample that is gathered on the driver."""
    return F.octet_length(text) <= SAMPLE_BYTES


def place(*columns: str | Column) -> Column:
    """A row's place in the sampling order: a hash of the columns, from 0 to SPAN."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPAN))


def first_by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n rows of ``df`` that come first by hash of ``columns``, with it as ``_place``.

    Rows are counted, and only those below a share of the hashes that should hold twice as many as
    are wanted are sorted; so little more than n rows leave their tasks, however many tasks there
    are. Where repeated values leave too few, the share is widened.
    """
    total = df.count()
    share = min(1.0, (2 * n + 100) / max(total, 1))
    placed = df.withColumn("_place", place(*columns))
    while share < 1.0 and placed.where(F.col("_place") < int(share * SPAN)).count() < n:
        share = min(1.0, share * 4)
    return placed.where(F.col("_place") < int(share * SPAN)).orderBy("_place", *columns).limit(n)
