"""Merkle manifests against a tree built plainly."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def one(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proofs(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k - k % 3 : k - k % 3 + 3]
            steps[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], steps


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for g, key, text in rows:
        groups[g].append((key is not None, key or 0, sha(one(g) + one(key) + one(text)), key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = proofs([x[2] for x in groups[g]])
    root, above = proofs([trees[g][0] for g in order])
    return sorted((str(x[3]), x[2], trees[g][0], root, tuple(steps + above[k])) for k, g in enumerate(order) for x, steps in zip(groups[g], trees[g][1], strict=True))


def table(n: int) -> list[tuple]:
    rows = [("hot" if i % 3 else f"s{i % 11}é" if i % 2 else None, i * 7 % n, f"text {i}\n") for i in range(n)]
    return rows + [("hot", None, None), ("hot", 5, ""), ("", 1, "x"), ("", None, "x")] + [("hot", 5, "same")] * 7


@pytest.mark.parametrize(("n", "rows_each", "up"), [(1, 100, 5), (2, 100, 5), (40, 3, 1), (400, 10, 1), (400, 25, 2), (700, 100_000, 5)])
def test_by_plain_tree(spark, monkeypatch, n, rows_each, up):
    if n == 40:
        monkeypatch.setattr(merkle, "BROADCAST_TOPS", 0)
    rows = table(n)
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    found = merkle.manifest(df, ["source", "doc_id", "text"], "source", "doc_id", partition_rows=rows_each, levels_up=up).collect()
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in found) == plain(rows)


def test_tampering_shows(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", "en", i, f"line\n{i}" if i % 3 else "line") for i in range(60)] + [(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.audit(df).withColumn("hit", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & (F.col("doc_id") % 3 != 0))
    assert out.where("verified = hit").count() == 0 and out.count() == 61
    assert out.select("root").distinct().count() == 1 and out.where("verified").where("folded_root != root").count() == 0


def test_one_row_has_an_empty_proof(spark):
    df = spark.createDataFrame([(1, "s", "en", 4, "text")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.audit(df).first()
    assert r["leaf"] == r["subroot"] == r["root"] == sha("1:1" + "1:s" + "2:en" + "1:4" + "4:text") and r["proof_sha256"] == sha("")
