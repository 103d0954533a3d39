"""A graph of passages that mention the same entities one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx

MENTIONS = 100


def mentions(passages: DataFrame) -> DataFrame:
    """(entity, id) from passages (id, text)."""
    return passages.select("id", F.explode(tx.entities(F.coalesce("text", F.lit("")))).alias("entity"))


def edges(passages: DataFrame, most: int = MENTIONS) -> DataFrame:
    """(src, dst) in both directions: neighbours among the first ``most`` mentions of an entity.

    The bound is the feature: it keeps a frequent word from linking everything. Spark applies it in
    each partition before the shuffle, so a hot entity sends few rows.
    """
    order = Window.partitionBy("entity").orderBy("id")
    first = mentions(passages).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    pairs = first.select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst")).where("dst is not null and src != dst")
    return pairs.union(pairs.select("dst", "src")).distinct()


def expand(seeds: DataFrame, graph: DataFrame) -> DataFrame:
    """(qid, id): seeds (qid, id) and their neighbours."""
    near = seeds.join(graph, seeds["id"] == graph["src"]).select("qid", F.col("dst").alias("id"))
    return seeds.select("qid", "id").union(near).distinct()
