from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from skein.llm import jaccard_join
from tests.llm import brute


def corpus(seed: int, groups: int, size: int) -> dict[int, str]:
    """Groups of texts that differ in a few words, with copies and unrelated texts between them."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts: list[str] = []
    for _ in range(groups):
        stem = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 6, 60, 150]))]
        for _ in range(size):
            copy = list(stem)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(80)) for _ in range(30)]
    rnd.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("groups", "size", "block"), [(12, 10, 1024), (2, 90, 16)])
def test_against_all_pairs(spark, monkeypatch, groups, size, block):
    """Also with blocks so small that groups are dealt into several."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", block)
    texts = corpus(groups, groups, size)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in jaccard_join.join(df).collect()}
    classes, links = brute.classes(texts)
    total, missed = sum(links.values()), sum(abs(links[i] - found[i]["n_links"]) for i in texts)
    assert missed <= 0.01 * total
    assert sum(found[i]["class_id"] != classes[i] for i in texts) <= 0.01 * len(texts)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(df).collect()}
    assert kept == {r["class_id"] for r in found.values()}


def test_driver_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    classes, links = brute.classes(texts)
    for r in jaccard_join.join(df).collect():
        assert (r["class_id"], r["n_links"]) == (classes[r["doc_id"]], links[r["doc_id"]])


def test_banding_reaches_its_recall():
    bands, rows = jaccard_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard_join.TARGET_RECALL and bands * rows <= jaccard_join.MOST_HASHES


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    out = jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in out} == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_repeated_ids_lose_no_link(spark):
    """Texts with one id are texts of their own, whatever the type of the ids."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "alone " * 9)]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        out = sorted((int(r["doc_id"]), int(r["class_id"]), r["n_links"]) for r in jaccard_join.join(df).collect())
        assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]
        kept = jaccard_join.keep_one(df.withColumn("_id", F.lit(7)).withColumn("_jid", F.lit(8)))
        assert kept.columns == ["doc_id", "text", "_id", "_jid"]
        assert sorted((int(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (4, "alone " * 9)])
