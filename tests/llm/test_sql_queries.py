"""Queries of this package that SQL can express, on the driver's rows; and brute force on planted ones."""

from __future__ import annotations

import pytest

from skein.llm import chat, mixing, quality_rules, queries
from tests import oracle
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert oracle.rows(out) == oracle.sql_rows(sf_dir, queries.ORACLE_SQL[name], out.columns)


def planted() -> list[dict]:
    """One host has a menu line in most documents; some documents hold little else."""
    docs = []
    for i in range(60):
        body = " ".join(f"t{i}w{k}" for k in range(40))
        text = f"Home | News | Page {i}\n{body}\nHome | News | Page {i}" if i % 3 else body
        text = f"Home | News | Page {i}\nonly a few more words are here than the menu has got" if i == 7 else text
        text = "Home | News | Page 3" if i == 8 else text
        text = f"{body} {body}" if i == 9 else text
        docs.append({"doc_id": i, "text": text, "source": "host" if i < 50 else None, "lang": "en"})
    return [*docs, docs[0], {"doc_id": 99, "text": None, "source": "host", "lang": None}]


def test_quality_rules(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    kept = sorted((r["doc_id"], r["text"]) for r in quality_rules.clean(df).collect())
    assert kept == sorted((d["doc_id"], d["text"]) for d in brute.quality(docs))
    assert not any("Home" in t for i, t in kept if i < 50)
    rows = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for d in docs:
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base(d["text"])
        assert r["kept"] == (d["doc_id"] in {i for i, _ in kept})


def test_a_large_host_does_not_loosen_the_limit(spark):
    bodies = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20)) for i in range(250)]
    docs = [{"doc_id": i, "text": f"Imprint {i}\n{body}" if i < 20 else body, "source": "host"} for i, body in enumerate(bodies)]
    table = quality_rules.line_table(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    for most in (19, 20):
        found = quality_rules.frequent_lines(table, max_docs=most).count()
        assert found == len(brute.frequent(docs, max_docs=most)) == (most < 20)


def test_mixing(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = {k: v for k, v in brute.mix(docs).items() if v}
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r["doc_id"]: r["n_copies"] for r in mixing.select(df).collect()} == wanted
    assert mixing.mix(df).count() == sum(wanted.values())


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "de", "b", 1000), ("code", "en", "c", 1000)], "domain string, lang string, source string, n_available long")
    weights = {"domain": {"web": 1, "code": 1}, "lang": {"en": 1, "de": 1}, "source": {}}
    budgets = {r["source"]: r["n_budget"] for r in mixing.leaf_budgets(leaves, weights, 20, 2).collect()}
    assert budgets == {"a": 20, "b": 181, "c": 201}
    few = leaves.where("source != 'b'")
    budgets = {r["source"]: r["n_budget"] for r in mixing.leaf_budgets(few, weights, 50, 2).collect()}
    assert budgets == {"a": 20, "c": 485}


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(10 + n, i, r, t) for n in (1, 2, 3, 4) for i, (r, t) in enumerate(turns[:n])]
    rows += [(5, i, r, t) for i, (r, t) in enumerate(turns)] + [(30, 0, "user", "hi"), (30, 1, "assistant", "other")] + [(40, 0, "assistant", "hi")]
    rows += [(50, i, "user", f"turn {i}") for i in range(2500)] + [(51, i, "user", f"turn {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r["conv_id"] for r in chat.maximal(df).collect()) == [5, 30, 40, 50]
    out = chat.render(df).where("conv_id = 5").first()
    assert out["rendered"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    long = chat.render(df).where("conv_id = 50").orderBy("part").collect()
    assert sum(r["n_turns"] for r in long) == 2500 and len(long) == 5
    assert "".join(r["rendered"] for r in long) == "".join(f"<|im_start|>user\nturn {i}<|im_end|>\n" for i in range(2500))
