"""Containment by grams against Python's ``in``."""

from __future__ import annotations

import random

import pytest

from skein.operators import knowledge, substrings
from skein.plans import catalog


def cases(seed: int) -> tuple[list[tuple], list[str]]:
    rng = random.Random(seed)
    words = ["tax", "กรุง", "é", "a", "long passage of words", "漢字かな", "\n", "x" * 30]
    texts = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(25)))) for i in range(300)] + [(300, None), (301, "")]
    needles = [t[a : a + rng.randrange(1, 40)] for _, t in rng.sample(texts[:300], 200) if t and (a := rng.randrange(len(t))) >= 0]
    return texts, [*needles, "never there", "zz", "", None, needles[0]]


@pytest.mark.parametrize(("filter_grams", "few"), [(10**6, 10**6), (0, 10**6), (10**6, 0)])
def test_same_as_contains(spark, monkeypatch, filter_grams, few):
    monkeypatch.setattr(substrings, "FILTER_GRAMS", filter_grams)
    monkeypatch.setattr(substrings, "FEW_PAIRS", few)
    texts, needles = cases(few + filter_grams)
    found = substrings.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted((r["id"], r["needle"]) for r in found.collect()) == sorted((i, n) for i, t in texts for n in {x for x in needles if x} if t and n in t)


def test_empty_tables(spark):
    texts, needles = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("b",)], "needle string")
    assert substrings.containing(texts, needles.where("false")).count() == 0
    assert substrings.containing(texts.where("false"), needles).count() == 0


@pytest.mark.parametrize("name", ["kg_query_seeds", "retrieval_scores", "retrieval_summary"])
def test_no_cartesian_plan(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    triples = spark.createDataFrame([(0, "Carbon tax", "is", "levy", "", 0.5, "c")], "ord long, source string, relation string, target string, evidence string, confidence double, source_chunk_id string")
    queries = spark.createDataFrame([(1, "what is the TAX on levies")], "qid long, text string")
    seeds = knowledge.seeds_by_query(triples, queries)
    assert "NestedLoop" not in seeds._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["node"] for r in seeds.collect()) == ["Carbon tax", "levy"]
