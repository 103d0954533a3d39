"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for all operators."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, jaccard_join, language_id, licenses, media, merkle, mixing, packing, pii, piece_bpe, quality_classifier, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, n_copies string, ids string, decoded string, score string, size string, kinds string, domain string"
LONG = "word " * 30_000 + "x" * 50_000 + " " * 2_000
TEXTS = [None, "", " ", "\n\n\n", "12 !! 34", "one two three", "the of and to in that is with for on as by at", LONG, "▁ � \U0001f642 กำ \x00 end"]


def documents(spark: SparkSession, texts: list[str | None] = TEXTS) -> DataFrame:
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None, 7, "x", "y", "z", "d", "s", "q", "k", "m") for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, "a row without an id", None, None, None, 1, *["c"] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


def model(df: DataFrame):
    return piece_bpe.vocabulary(df, public_tokenizers.path("piece_bpe_32k.model"))


ALL = {
    "encode": lambda df: piece_bpe.decode(piece_bpe.encode(df, model(df)), model(df)),
    "round trip": lambda df: piece_bpe.round_trip(df, model(df)),
    "encode array": lambda df: piece_bpe.decode(piece_bpe.encode(df, model(df), packed=False), model(df)),
    "pii": pii.pseudonymise,
    "jaccard": jaccard_join.join,
    "licenses": licenses.scan,
    "media": media.media_columns,
    "quality rules": quality_rules.judge,
    "mixing": mixing.select,
    "classifier": quality_classifier.classify,
    "language": language_id.identify,
    "packing": lambda df: packing.pack(df, packing.tokeniser(df, public_tokenizers.path("byte_bpe_50k.json"))).where("start = 0"),
    "merkle": merkle.audit,
}
PER_ROW = {"packing", "merkle", "encode", "round trip", "encode array", "pii", "jaccard", "licenses", "media", "quality rules", "classifier", "language"}


@pytest.mark.parametrize("name", ALL)
def test_edge_rows(spark, name):
    df = documents(spark)
    out = ALL[name](df)
    n = out.count()
    assert n == df.count() if name in PER_ROW else n <= df.count()


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](documents(spark).where("false")).count() == 0


@pytest.mark.parametrize("stage", [quality_rules.clean, jaccard_join.keep_one, mixing.mix])
def test_filters_keep_columns(spark, stage):
    df = documents(spark)
    assert stage(df).columns == df.columns
    assert stage(df.where("false")).count() == 0


@pytest.mark.parametrize("stage", [quality_rules.clean, jaccard_join.keep_one, mixing.mix, pii.pseudonymise])
def test_columns_named_like_helpers(spark, stage):
    names = ["_mid", "_mtext", "_mcopies", "_qid", "_qtext", "_qkeys", "_id", "_whole", "_row", "_class"]
    df = documents(spark).select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    out = stage(df)
    assert all(r[c] == f"own {c}" for r in out.collect() for c in names)


def test_null_text_results(spark):
    df = documents(spark)
    assert quality_rules.judge(df).where("doc_id = 0").first()["base_failed"]
    assert language_id.identify(df).where("doc_id = 0").first()["lang_pred"] == "und"
    assert quality_classifier.classify(df).where("doc_id = 0").first()["score"] == 0
    assert licenses.scan(df).where("doc_id = 0").first()["licenses"] == []
    assert pii.pseudonymise(df).where("doc_id = 0").first()["n_found"] == 0
    assert media.media_columns(df).where("doc_id = 0").first()["payload_bytes"] == 64


def test_repeated_rows_are_equal(spark):
    df = documents(spark)
    last = len(TEXTS) - 1
    for name in sorted(PER_ROW - {"packing", "merkle"}):  # each row has a place of its own there
        rows = ALL[name](df).where(F.col("doc_id") == last).collect()
        assert len(rows) == 3 and len({str(r) for r in rows}) == 1, name


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, part string, p1 string"
    rows = [(1, 0, "user", "a", "x", "y"), (1, 0, "user", "a", "x", "y"), (1, None, None, None, "x", "y"), (None, 0, "user", "b", "x", "y"), (2, 5000, "user", "<|im_end|>", "x", "y"), (2, 0, "user", "far", "x", "y")]
    df = spark.createDataFrame(rows, schema)
    out = chat.render(df).orderBy("conv_id", "part").collect()
    # The null turn is the first step of conversation 1 and is rendered apart.
    assert [(r["conv_id"], max(r["part"], -1), r["n_turns"]) for r in out] == [(None, 0, 1), (1, -1, 1), (1, 0, 1), (2, 0, 1), (2, 9, 1)]
    assert out[-1]["rendered"] == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat.render(df.where("false")).count() == 0


def test_chat_prefixes_by_rank(spark):
    """Snapshots are found whatever their turn numbers begin with; rows without an id stay apart."""
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 1, "u", "a"), (2, 2, "v", "b"), (2, 7, "u", "c"), (3, 0, "v", "b"), (3, 1, "u", "a")]
    rows += [(None, 3, "u", "a"), (None, 4, "x", "y"), (None, 4, "x", "z")] + [(4, i, "u", f"t{i}") for i in range(3000)] + [(5, i + 50, "u", f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(df).collect()
    assert sorted({r["conv_id"] for r in out if r["conv_id"]}) == [2, 3, 4] and sum(r["n_turns"] for r in out if r["conv_id"] == 4) == 3000
    assert sorted(r["rendered"] for r in out if r["conv_id"] is None) == [f"<|im_start|>x\n{t}<|im_end|>\n" for t in "yz"]
