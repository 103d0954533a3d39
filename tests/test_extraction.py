"""Extraction that stops: budgets, failures, restarts, with a model that counts its calls in a file."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.sources import versions
from skein.streaming import extraction

TOKENS = 100


@pytest.fixture
def sections(spark):
    rows = [(f"n{i:02d}.md", k, "H", f"fact {i} {k}") for i in range(20) for k in range(2)] + [("copy.md", 0, "H", "fact 3 1")]
    return spark.createDataFrame(rows, "path string, ord int, heading string, text string").withColumn("key", tx.section_key(F.col("heading"), F.col("text")))


def counting(path, fail: str = "never"):
    """A model that makes a triple of each labelled section, and raises where the prompt has ``fail``."""
    def model(prompt: str) -> tuple[str, int]:
        with open(path, "a") as calls:
            calls.write("call\n")
        if re.search(fail, prompt):
            raise OSError("no quota")
        keys = re.findall(r"\[chunk (\w+)\]", prompt)
        return json.dumps([{"source": "A", "relation": "r", "target": k, "source_chunk_id": k} for k in keys]), TOKENS

    return model


def calls(path) -> int:
    return len(path.read_text().splitlines()) if path.exists() else 0


def test_all_sections_are_read_once(spark, sections, tmp_path):
    folder, log = str(tmp_path / "x"), tmp_path / "calls"
    assert extraction.extract(sections, folder, counting(log), per_wave=8, limit=40) is None
    keys = sorted(r["key"] for r in sections.select("key").distinct().collect())
    assert sorted(r["key"] for r in extraction.ledger(spark, folder).collect()) == keys and len(keys) == 40
    assert sorted(r["target"] for r in extraction.triples(spark, folder).collect()) == keys
    last = extraction.progress(spark, folder).orderBy(F.desc("wave")).first()
    assert (last["done"], last["failed"], last["triples"], last["tokens"]) == (40, 0, 40, TOKENS * calls(log))
    before = calls(log)
    assert extraction.extract(sections, folder, counting(log)) is None and calls(log) == before


def test_a_budget_is_kept_over_restarts(spark, sections, tmp_path):
    folder, log = str(tmp_path / "x"), tmp_path / "calls"
    for _ in range(3):
        assert extraction.extract(sections, folder, counting(log), budget=1000, per_wave=4, limit=1) == "all 1,000 tokens of the run are spent"
        assert 10 <= calls(log) < 10 + 4
    assert extraction.ledger(spark, folder).count() == calls(log)
    assert extraction.extract(sections, folder, counting(log), budget=200, run="next", per_wave=4, limit=1).startswith("all 200")
    assert calls(log) <= 13 + 5 and extraction.ledger(spark, folder).count() == calls(log)
    # Estimates keep a micro-batch from asking more than the rest can pay.
    few, other = tmp_path / "few", str(tmp_path / "y")
    extraction.extract(sections, other, counting(few), budget=12, per_wave=30, limit=1)
    assert calls(few) < 5


def test_a_failed_call_is_a_row(spark, sections, tmp_path):
    folder, log = str(tmp_path / "x"), tmp_path / "calls"
    why = extraction.extract(sections, folder, counting(log, "fact 7 0"), per_wave=100, limit=1)
    assert why == "OSError: no quota; other sections wait" and calls(log) == 40
    assert extraction.ledger(spark, folder).count() == 39
    assert extraction.progress(spark, folder).first()["failed"] == 1
    assert extraction.extract(sections, folder, counting(log)) is None and calls(log) == 41
    odd = extraction.extract(sections, str(tmp_path / "z"), lambda prompt: ("no list here", 5), per_wave=2)
    assert odd.startswith("the reply has no list") and extraction.ledger(spark, str(tmp_path / "z")).count() == 0


def test_stop_on_request(spark, sections, tmp_path):
    folder, log, asked = str(tmp_path / "x"), tmp_path / "calls", []
    why = extraction.extract(sections, folder, counting(log), per_wave=3, limit=1, stop=lambda: asked.append(1) or len(asked) > 2)
    assert why == "stopped on request" and calls(log) == 6 == extraction.ledger(spark, folder).count()


def test_a_lost_driver(spark, sections, tmp_path, monkeypatch):
    folder, log = str(tmp_path / "x"), tmp_path / "calls"
    settle = extraction.Ledger.settle
    # Lost after the replies were written: they are taken over, not asked again.
    state = {"n": 0}

    def lost(self):
        state["n"] += 1
        if state["n"] == 3:
            raise KeyboardInterrupt
        return settle(self)

    monkeypatch.setattr(extraction.Ledger, "settle", lost)
    with pytest.raises(KeyboardInterrupt):
        extraction.extract(sections, folder, counting(log), per_wave=5, limit=1)
    assert calls(log) == 10 and extraction.ledger(spark, folder).count() == 5
    monkeypatch.setattr(extraction.Ledger, "settle", settle)
    assert extraction.extract(sections, folder, counting(log), per_wave=5, limit=1) is None and calls(log) == 40
    # Lost while asking: what was noted counts as spent.
    other = str(tmp_path / "y")
    book = extraction.Ledger(spark, other, "run")
    book.begin(5000)
    assert extraction.extract(sections, other, counting(log), budget=4000).startswith("all 4,000") and calls(log) == 40
    assert not any(x.startswith("asking") for x in versions.load(spark, other).parts)
