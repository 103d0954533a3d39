"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, jaccard_join, language_id, licenses, media, merkle, mixing, packing, pii, piece_bpe, quality_classifier, quality_rules, vector_codes
from skein.llm.common import read


def piece_model() -> str:
    """The path of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokeniser() -> str:
    """The path of the tokeniser that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = piece_bpe.vocabulary(docs, piece_model())
    return piece_bpe.round_trip(docs, model, keep_text=False).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs).select("doc_id", "n_found", "kinds", "text")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(read(spark, sf_dir, "documents")).drop("_mtext")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pieces = packing.pack(docs, packing.tokeniser(docs, byte_tokeniser()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op5_media_columns": op5_media_columns,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
