"""A saved index: passages with vectors, postings, graph and a line of metadata, as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import bm25, entity_graph


@dataclass
class Stored:
    passages: DataFrame
    words: bm25.Index
    graph: DataFrame


def save(passages: DataFrame, folder: str, embedder: str) -> None:
    """Write ``passages`` (id, file, page, text, vec) and what is derived from them.

    Postings are sorted by term within files, so that a search reads few row groups.
    """
    passages.write.mode("overwrite").parquet(f"{folder}/passages")
    stored = passages.sparkSession.read.parquet(f"{folder}/passages")
    built = bm25.index(stored.select("id", "text"))
    built.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    entity_graph.edges(stored.select("id", "text")).write.mode("overwrite").parquet(f"{folder}/graph")
    totals = built.totals.withColumn("embedder", F.lit(embedder))
    totals.write.mode("overwrite").parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str, embedder: str) -> Stored:
    """Read an index; raises ``ValueError`` if another embedder made it."""
    meta = spark.read.parquet(f"{folder}/meta")
    made_by = meta.first()["embedder"]
    if made_by != embedder:
        raise ValueError(f"the index was made with {made_by}, not {embedder}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Stored(read("passages"), bm25.Index(read("postings"), meta.select("n", "average")), read("graph"))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(part, bytes) on disk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    part = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.groupBy(part.alias("part")).agg(F.sum("length").alias("bytes"))
