"""A corpus from raw documents: each stage calls one of the training-data operators.

``run`` has no SQL: SQL has no SentencePiece encoder and no Feistel pseudonyms. The tests compare it
with a brute-force version on a small fixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard_join, mixing, pii, piece_bpe, quality_rules
from skein.llm.queries import piece_model


#: Rows that go to a Python worker at once: a batch of whole texts is held by Spark and by the worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are frequent on their host."""
    return quality_rules.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data and secrets."""
    return pii.pseudonymise(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets of their domain, language and source; one row per epoch."""
    return mixing.mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and whether they decode to the text."""
    small_batches(spark)
    model = piece_bpe.vocabulary(docs, piece_model())
    decoded = piece_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), model)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", without_personal_data),
    ("mixing", mixed),
    ("SentencePiece", tokenised),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
