"""Vector codes against plain Python in exact integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import pytest

from skein.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, vector int, n int"


def plain(rows: list[tuple]) -> dict[int, tuple]:
    kept = sorted((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    wide = len(whole[0]) // 8
    cut = [[v[p * wide : (p + 1) * wide] for p in range(8)] for v in whole]
    books = [[list(v[p]) for v in cut[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            met = defaultdict(list)
            for v in cut:
                met[near(v[p], books[p])[1]].append(v[p])
            for k, xs in met.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = {i: [near(v[p], books[p]) for p in range(8)] for (i, _, _), v in zip(kept, cut, strict=True)}
    by_label = defaultdict(int)
    for i, _, label in kept:
        by_label[label] += sum(d for d, _ in found[i])
    return {i: ("".join(f"{k:02x}" for _, k in found[i]), sum(d for d, _ in found[i]), by_label[label], digest) for i, _, label in kept}


def table(n: int, width: int = 16) -> list[tuple]:
    rng = random.Random(n)
    rows = [(i * 3, [rng.choice([rng.gauss(0, 1), 0.25, -1.5]) for _ in range(width)], rng.choice(["a", "b", None])) for i in range(n)]
    odd = [None, [], [None] * width, [math.nan] + [0.0] * (width - 1), [math.inf] * width, [0.0] * (width - 1) + [None]]
    return rows + [(1 + 3 * i, v, "odd") for i, v in enumerate(odd)]


@pytest.mark.parametrize("n", [1, 5, 16, 300])
def test_by_hand(spark, n, monkeypatch):
    rows = table(n)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    for limit in (100_000, 0):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", limit)
        found = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(df).collect()}
        assert found == plain(rows)


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in table(40)], SCHEMA)
    out = vector_codes.compress(df.where("false"))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(df.where("vec_id % 3 = 1")).count() == 0
    twice = vector_codes.compress(df.union(df)).collect()
    assert len(twice) == 80 and len({(r["vec_id"], r["code"], r["error"]) for r in twice}) == 40
    longer = spark.createDataFrame([(900, [0.5] * 24, "a", "x", 1, 2), (901, [0.5] * 17, "a", "x", 1, 2), (902, [3e38] * 16, "a", "x", 1, 2), (None, [0.5] * 16, "a", "x", 1, 2)], SCHEMA)
    ids = {r["vec_id"]: r["error"] for r in vector_codes.compress(df.union(longer)).collect()}
    assert not {900, 901} & set(ids) and {902, None} < set(ids) and all(x >= 0 for x in ids.values())


def test_codes_stand_for_near_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kept = vector_codes.usable(vectors)
    books = vector_codes.train(kept)
    coded = vector_codes.decode(vector_codes.encode(kept, books), books).join(kept.withColumnRenamed("vector", "own").drop("label"), "vec_id")
    rows = coded.collect()
    error = sum((a - b) ** 2 for r in rows for a, b in zip(r["vector"], r["own"], strict=True)) / len(rows)
    whole = sum(b**2 for r in rows for b in r["own"]) / len(rows)
    assert error < 0.7 * whole
    assert abs(error - sum(r["error"] for r in rows) / len(rows) / 4096**2) < 0.01


def test_query_is_registered():
    assert {"op12_vector_codes", "op13_merkle_manifest"} <= set(queries.ORACLE_SQL)
