"""Thai words by maximal matching against all segmentations, and in BM25."""

from __future__ import annotations

import dataclasses
import random
import unicodedata

from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.functions import thai
from skein.operators import bm25

WORDS = ["ปีงบประมาณ", "ปี", "งบ", "ประมาณ", "คาด", "คาดว่า", "ว่า", "จะ", "ขยาย", "ขยายตัว", "ตัว"]


def best(run: str, words: set[str]) -> tuple[tuple[int, int], list[int]]:
    """The least cost of all segmentations, and the word lengths of the one that takes long words first."""
    found = []

    def go(i: int, tokens: list[tuple[str, bool]]) -> None:
        if i == len(run):
            unknown = sum(len(t) for t, known in tokens if not known)
            found.append(((unknown, len(tokens)), [-len(t) if known else 0 for t, known in tokens], [t for t, _ in tokens]))
            return
        fits = i == 0 or not unicodedata.category(run[i]).startswith("M")
        for j in range(i + 1, len(run) + 1):
            if fits and run[i:j] in words and (j == len(run) or not unicodedata.category(run[j]).startswith("M")):
                go(j, [*tokens, (run[i:j], True)])
        if tokens and not tokens[-1][1]:
            go(i + 1, [*tokens[:-1], (tokens[-1][0] + run[i], False)])
        elif fits:
            go(i + 1, [*tokens, (run[i], False)])

    go(0, [])
    return min(found)


def test_shortest_path_is_the_best_of_all():
    rng = random.Random(4)
    letters = "กขค" + "ิ่"
    for _ in range(600):
        words = {w for _ in range(rng.randrange(1, 9)) if not unicodedata.category((w := "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))))[0]).startswith("M")}
        run = "ก" + "".join(rng.choice(letters) for _ in range(rng.randrange(9)))
        cost, _, _ = best(run, words)
        made = thai.segment(run, thai.prefixes(words))
        assert "".join(made) == run
        assert (sum(len(t) for t in made if t not in words), len(made)) == cost or sum(len(t) for t in made if t not in words) <= cost[0] and len(made) == cost[1]


def test_mixed_scripts(spark):
    tokens = thai.segmenter(spark, WORDS)
    rows = [("ปีงบประมาณ ๒๕69 คาดว่าจะขยายตัว",), ("Growth of GDP_2569, ก a ตัวx",), ("No Thai here 12 a ๒๕",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string").select(tokens(F.col("text")).alias("w"), tx.tokens(F.col("text")).alias("plain"))
    found = [(r["w"], r["plain"]) for r in df.collect()]
    assert found[0][0] == ["ปีงบประมาณ", "2569", "คาดว่า", "จะ", "ขยายตัว"]
    assert found[1][0] == ["growth", "of", "gdp_2569", "ก", "a", "ตัว", "x"]
    assert all(w == plain for w, plain in found[2:])
    without = thai.segmenter(spark, spark.createDataFrame([(w,) for w in WORDS if w != "คาดว่า"], "word string"))
    assert spark.createDataFrame(rows[:1], "text string").select(without(F.col("text")).alias("w")).first()["w"] == ["ปีงบประมาณ", "2569", "คาด", "ว่า", "จะ", "ขยายตัว"]


def test_bm25_finds_thai_words(spark):
    passages = spark.createDataFrame([(0, "รายงานปีงบประมาณ2569"), (1, "คาดว่าจะขยายตัว"), (2, "plain words")], "id long, text string")
    queries = spark.createDataFrame([(1, "ขยายตัว"), (2, "งบประมาณ"), (3, "words")], "qid long, text string")
    for profile in (bm25.OKAPI, bm25.FULL_TEXT):
        own = dataclasses.replace(profile, words=thai.segmenter(spark, [*WORDS, "งบประมาณ", "รายงาน"]))
        first = {r["qid"]: (r["id"], r["score"] > 0) for r in bm25.search(queries, passages, 1, own).collect()}
        plain = {r["qid"]: r["score"] > 0 for r in bm25.search(queries, passages, 1, profile).collect()}
        assert first[1] == (1, True) and first[3] == (2, True)
        assert not plain.get(1) and plain[3]
