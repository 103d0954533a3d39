"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60


def fuse(lists: list[DataFrame], k: int, constant: int = CONSTANT) -> DataFrame:
    """(qid, rank, id, score): the sum of 1 / (constant + rank); ties go to the first appearance.

    Each list is (qid, rank, id). Sums are exact to nine decimals, so ties do not depend on the plan.
    """
    rows = reduce(DataFrame.unionByName, (x.select("qid", "rank", "id", F.lit(i).alias("list_no")) for i, x in enumerate(lists)))
    total = rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("first"), F.asc("id"))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", F.round("score", 6).alias("score"))
