"""Session operators on literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import sessions


def test_report(spark):
    hits = spark.createDataFrame([(1, 2, "b.md", "y" * 900), (1, 1, "a.md > H (line 3)", "x" * 900), (2, 1, "c.md", "short")], "qid long, place int, label string, text string")
    facts = spark.createDataFrame([(1, 1, "A", "to", "B", "a.md")], "qid long, rank int, source string, relation string, target string, where string")
    out = {r["qid"]: r["report"] for r in sessions.search_report(hits, facts, 600).collect()}
    head = "found: [1] a.md > H (line 3), [2] b.md"
    graph = "\n\nFacts from the notes:\n- A --to--> B  (a.md)"
    per = max(200, (600 - len(head) - len(graph)) // 2 - 40)
    assert out[1] == f"{head}\n\n[1] a.md > H (line 3)\n{'x' * per}\n\n[2] b.md\n{'y' * per}{graph}"
    assert out[2] == "found: [1] c.md\n\n[1] c.md\nshort"


def test_registry_and_models(spark):
    declared = spark.createDataFrame([("read", "path", True), ("read", "limit", False), ("grep", "x", True)], "tool string, arg string, required boolean")
    actual = spark.createDataFrame([("read", "path", False), ("read", "limit", False), ("read", "extra", True)], "tool string, arg string, has_default boolean")
    out = {(r["tool"], r["arg"]): r["problem"] for r in sessions.registry_audit(declared, actual).collect()}
    assert out == {("read", "limit"): "required and default disagree", ("read", "extra"): "in the signature, not declared", ("grep", "x"): "declared, not in the signature"}
    roles = spark.createDataFrame([("actor", "m1", {"a": "role"})], "role string, model string, options map<string,string>")
    models = spark.createDataFrame([("m1", "v", {"a": "model", "b": "model"})], "model string, vendor string, options map<string,string>")
    vendors = spark.createDataFrame([("v", {"b": "vendor", "c": "vendor"})], "vendor string, options map<string,string>")
    assert sessions.resolve_models(roles, models, vendors).first()["options"] == {"a": "role", "b": "model", "c": "vendor"}


def test_errors_and_secrets(spark):
    rows = spark.createDataFrame([(413, "Limit 8000, Requested 9100"), (429, "tokens per day; try again in 2m3.5s"), (429, "try again in 300ms"), (500, "x")], "status int, body string")
    out = [r["e"] for r in rows.select(sessions.provider_error(F.col("status"), F.col("body")).alias("e")).collect()]
    assert out == ["the plan does not take a request of this size (9,100 tokens, at most 8,000); shorten the conversation", "no tokens of this model are left today; try again in 2m3.5s", None, None]
    waits = rows.select(sessions.retry_after(F.lit("7"), F.col("body"), F.lit(0)).alias("w")).collect()
    assert [r["w"] for r in waits] == [7.0, 7.0, 7.0, 7.0]
    assert rows.limit(1).select(sessions.redact(F.lit("key abc and abc"), ["abc", ""]).alias("t")).first()["t"] == "key [redacted] and [redacted]"


def test_extraction_requests(spark):
    sections = spark.createDataFrame([(0, "p", 1, "k2", "H", "two"), (0, "p", 0, "k1", "", "one"), (1, "q", 0, "k3", "", "three")], "batch int, path string, ord int, key string, heading string, text string")
    asked = sessions.prompts(sections, "batch", "Extract.").orderBy("batch").collect()
    assert asked[0]["prompt"] == "Extract.\n\n[chunk k1]\none\n\n[chunk k2]\nH\ntwo" and asked[0]["batch_ids"] == ["k1", "k2"]
    replies = sessions.ask(sessions.prompts(sections, "batch", ""), lambda texts: [str(len(t)) for t in texts]).collect()
    assert all(r["reply"] == str(len(r["prompt"])) for r in replies)
    costs = spark.createDataFrame([(0, 60), (1, 60), (2, 60)], "batch int, tokens int")
    assert [r["runs"] for r in sessions.budgeted(costs, "tokens", 100).orderBy("batch").collect()] == [True, True, False]
    assert sessions.event_lines(costs.limit(1)).first()["line"] == 'data: {"batch":0,"tokens":60}\n\n'
