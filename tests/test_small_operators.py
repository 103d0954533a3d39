"""Operators that no registered query covers, on literal rows and against plain Python."""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.functions import actions, html
from skein.functions import text as tx
from skein.operators import chunking, dense, evaluation, files, incremental, knowledge, mutations, rules, sessions
from skein.sources import documents, notes, tables, trace_store
from skein.sources import versions
from skein.streaming import index as index_stream


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_hash_embedding_counts_words(spark):
    texts = [(0, "Ab ab cd"), (1, None), (2, ""), (3, "x"), (4, " ".join(f"w{i % 90}" for i in range(5000)))]
    got = {r["id"]: r["vec"] for r in dense.hash_embed(spark.createDataFrame(texts, "id int, text string").coalesce(1)).collect()}
    for number, text in texts:
        want = np.zeros(256)
        for word in re.findall(r"\w{2,}", (text or "").lower()):
            want[zlib.crc32(word.encode()) % 256] += 1
        assert np.allclose(got[number], want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_hash_embedding_counts_a_few_texts_at_a_time(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "ab cd " * i + f"w{i}") for i in range(5)] + [(5, None)], "id int, text string").coalesce(1)
    whole = values(dense.hash_embed(texts), "id", "vec")
    monkeypatch.setattr(dense, "TEXTS", 2)
    assert values(dense.hash_embed(texts), "id", "vec") == whole


def test_brief_measures_the_value_as_given(spark):
    lines = "a" * 68 + "\n" + "b"
    found = one(spark, short=tx.brief(F.lit(lines)), long=tx.brief(F.lit(lines + "c")))
    assert found["short"] == "a" * 68 + " ⏎ b" and found["long"] == "a" * 68 + " …"


def test_repeats_are_dropped_within_a_row(spark):
    long, other = "This sentence has more than forty characters in it.", "Another one that has more than forty characters too!"
    pages = [(1, f"{long} Yes. {long.upper()}\r\n\n{other}\t \n  {other}\n \nYes. {other}  Yes."), (2, None), (3, f"{long}\n{other}")]
    found = chunking.drop_repeats(spark.createDataFrame(pages, "id int, text string"), "id")
    assert values(found, "key", "text", "looped") == [(1, f"{long} Yes.\n\n{other}\n\nYes. Yes.", True), (2, "", False), (3, f"{long}\n{other}", False)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_greedy_batches_by_brute_force(spark):
    draw = random.Random(5)
    rows = [(g, i, draw.choice([0, 1, 40, 99, 250, None]), {"a": g}) for g in ("p", "q", None) for i in range(200)]
    rows = [(g, i, n, json.dumps(x)) for g, i, n, x in rows]
    want = set()
    for group in ("p", "q", None):
        batch = total = 0
        for g, i, n, _ in rows:
            if g == group:
                if total > 0 and total + (n or 0) > 100:
                    batch, total = batch + 1, 0
                total += n or 0
                want.add((g, i, batch))
    table = spark.createDataFrame(rows, "g string, i int, n int, extra string").repartition(5)
    found = chunking.greedy_batches(table, "n", 100, ["i"], ["g"])
    assert {(r["g"], r["i"], r["batch"]) for r in found.collect()} == want
    assert chunking.greedy_batches(table.limit(0), "n", 100, ["i"], ["g"]).count() == 0


def test_budget_over_ranges(spark):
    costs = spark.range(5000).select(F.col("id").alias("batch"), F.lit(2).alias("tokens"))
    assert sessions.budgeted(costs, "tokens", 6001).where("runs").count() == 3001
    assert sessions.budgeted(costs.limit(0), "tokens", 5).count() == 0


def test_extraction_stops(spark):
    schema = "batch int, keys array<string>, failed array<string>, tokens int, triples int"
    rows = [(0, ["a", "b"], [], 100, 3), (1, ["c"], [], 100, 1), (2, ["d", "e"], ["e"], 100, 1), (3, ["f"], [], 100, 1)]
    outcomes = spark.createDataFrame(rows, schema)
    progress, saved = sessions.extraction_outcome(outcomes)
    assert values(progress, "batch", "done", "failed", "tokens", "triples") == [(0, 2, 0, 100, 3), (1, 3, 0, 200, 4), (2, 4, 1, 300, 5)]
    assert [r["stopped"] for r in progress.orderBy("batch").collect()] == [None, None, "a call failed, other sections wait"]
    assert values(saved, "key") == [("a",), ("b",), ("c",), ("d",)]
    progress, saved = sessions.extraction_outcome(outcomes, 150)
    assert [r["stopped"] for r in progress.orderBy("batch").collect()] == [None, "all 150 tokens are spent"]
    assert values(saved, "key") == [("a",), ("b",), ("c",)]


def test_changes_in_sequence(spark):
    old = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "E\n")], "path string, text string")
    changes = [
        (1, "write", "a", None, "new"), (2, "append", "a", None, "x"), (3, "move", "a", "z", None),
        (4, "move", "b", "y", None), (5, "move", "c", "y", None),
        (6, "delete", "d", None, None), (7, "append", "d", None, "again"),
        (8, "append", "e", None, "more"), (9, "append", "f", None, "first"),
    ]
    kept, trash = mutations.apply_changes(old, spark.createDataFrame(changes, "seq int, kind string, path string, dest string, text string"))
    assert values(kept, "path", "text") == [("c", "C"), ("d", "again"), ("e", "E\nmore"), ("f", "first"), ("y", "B"), ("z", "new\nx")]
    assert values(trash, "path", "text") == [("d", "D")]


def test_arguments_and_events(spark):
    declared = {"path": {"type": "string", "required": True}, "n": {"type": "integer"}, "x": {"type": "number"}, "all": {"type": "boolean"}}
    given = F.create_map(*(F.lit(v) for v in ("path", " a", "n", " 3 ", "x", "1.5", "all", "Yes")))
    assert tuple(one(spark, got=rules.coerce_args(given, declared))["got"]) == (" a", 3, 1.5, True)
    bad = F.create_map(F.lit("n"), F.lit("many"))
    assert tuple(one(spark, got=rules.coerce_args(bad, declared))["got"]) == (None, None, None, None)
    required, enums = {"step": ["session"], "file": ["kind"]}, {"file": {"kind": ["write", "move"]}}
    events = [({"type": "step", "session": "s", "tool": "t"}, None), ({"type": "step", "session": "s", "zz": "1", "b": "2"}, "unknown field b, zz"), ({"type": "step"}, "missing field session"), ({"type": "file", "kind": "x"}, "kind must be one of write, move"), ({"type": "file", "kind": "move", "more": "1"}, None), ({"a": "b"}, "unknown type")]
    rows = spark.createDataFrame(events, "event map<string,string>, wanted string").select("wanted", rules.validate_event(F.col("event"), required, enums, {"step": ["tool"]}).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["wanted"] for r in rows]


def test_workflow_conditions(spark):
    row = one(spark, always=rules.needs_review(F.lit("x"), F.lit("always"), F.lit(False)), auto=rules.needs_review(F.lit("x"), F.lit("auto"), F.lit(True)), unused=rules.needs_review(F.lit("x"), F.lit("auto"), F.lit(False)), empty=rules.needs_review(F.lit(None).cast("string"), F.lit("always"), F.lit(True)), stuck=rules.no_progress(F.lit(3), 3), fine=rules.no_progress(F.lit(2), 3))
    assert tuple(row) == (True, True, False, False, True, False)


def test_summaries(spark):
    read = spark.createDataFrame([("a", 0.1, 0.9, 1.0), ("a", 0.3, 0.7, 0.5)], "engine string, cer double, word_recall double, number_recall double")
    assert tuple(evaluation.reading_summary(read, "engine").first()) == ("a", 2, 0.2, 0.8, 0.7, 0.75)
    pairs = spark.createDataFrame([(1, "pay 1,200 and 3.5 twice 7", "pay 1200 and 7"), (2, "no digits", "no digits")], "id int, t string, r string")
    assert values(evaluation.reading_accuracy(pairs, "id", "t", "r"), "key", "number_recall") == [(1, 0.666667), (2, 0.0)]
    graded = spark.createDataFrame([("rag", True, "correct", 10), ("rag", True, "partial", 20), ("rag", False, "correct", 6)], "mode string, answerable boolean, grade string, tokens int")
    assert values(evaluation.answer_summary(graded), "mode", "answerable", "n", "correct", "partial", "tokens") == [("rag", False, 1, 1.0, 0.0, 6.0), ("rag", True, 2, 0.5, 0.5, 15.0)]
    gold = spark.createDataFrame([(1, [("a", 1), ("a", 2)]), (2, [("a", 1), ("b", 1)]), (3, [("b", 1)]), (4, []), (5, None)], "id int, gold array<struct<file: string, page: int>>")
    assert values(gold.where(evaluation.small_document(F.col("gold"), ["a"])), "id") == [(1,)]


def test_texts(spark):
    row = one(spark, headed=tx.embed_text(F.lit("p.md"), F.lit("H"), F.lit("t")), plain=tx.embed_text(F.lit("p.md"), F.lit(""), F.lit("t")), fenced=tx.fenced_json(F.lit("a\n```json\n{1}\n```\nb\n```json\n{2}\n```")), none=tx.fenced_json(F.lit("{1}")), filled=actions.fill("{a} {b} {c}", {"a": F.lit("x"), "b": F.lit(2)}), text=html.plain_text(F.lit("<p>a <b>b</b></p><script>no</script>")))
    assert (row["headed"], row["plain"], row["fenced"], row["none"], row["filled"]) == ("p.md > H\nt", "p.md\nt", "{2}\n", None, "x 2 {c}")
    assert row["text"].split() == ["a", "b"]
    secrets = F.create_map(*(F.lit(v) for v in ("API_KEY", "1", "home", "2", "db_password", "3")))
    assert one(spark, env=files.without_secrets(secrets))["env"] == {"home": "2"}


def test_files_and_pages(spark, tmp_path):
    for name, body in (("a.md", b"# A"), ("sub/Code.py", b"x = 1"), (".exec/log", b"no"), ("sub/.git/x", b"no"), ("bad.bin", b"\xff")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = notes.files(spark, str(tmp_path))
    assert values(found, "path", "text") == [("a.md", "# A"), ("bad.bin", "\ufffd"), ("sub/Code.py", "x = 1")]
    assert values(files.named(found, "code"), "path") == [("sub/Code.py",)] and files.named(found, "sub").count() == 0
    content = spark.createDataFrame([("t.txt", b"a  b\n\n\n\nc")], "path string, content binary")
    assert tuple(documents.text_pages(content).first()) == ("t.txt", 1, "a b\n\nc", "text")
    pages = spark.createDataFrame([(1, "native"), (2, "native, unread"), (3, "ocr")], "page int, method string")
    assert values(files.unread_pages(pages), "page") == [(2,)]


def test_tables_and_traces(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": 1, "q": "a"}\n\n{"id": 2, "q": "b"}\n')
    rows = tables.jsonl(spark, str(tmp_path / "q.jsonl"), "id int, q string")
    assert values(rows, "id", "q") == [(1, "a"), (2, "b")]
    tables.write_csv(rows, str(tmp_path / "out"))
    assert values(spark.read.option("header", True).csv(str(tmp_path / "out")), "id", "q") == [("1", "a"), ("2", "b")]
    for number in (0, 1):
        trace_store.append_steps(spark.createDataFrame([(number, "x" * 4100)], "step int, observation string"), str(tmp_path / "steps"))
    steps = spark.read.parquet(str(tmp_path / "steps")).collect()
    assert len(steps) == 2 and all("truncated 100 chars" in r["observation"] for r in steps)
    listed = spark.createDataFrame([("s", "do it\n\nAttached file a.pdf: 3 pages", "done", 1, None, None)], "id string, task string, status string, started_at int, finished_at int, total_tokens int")
    assert tuple(sessions.session_list(listed).first()) == ("s", "do it", "done", 1, 1, 0)


def test_index_upkeep(spark):
    encode = lambda df: df.withColumn("vec", F.array(F.lit(2.0).cast("float")))
    chunks = spark.createDataFrame([("1", "a", [1.0]), ("2", "a", None)], "id string, path string, vec array<float>")
    assert values(incremental.reembed(chunks, encode), "id", "vec") == [("1", [1.0]), ("2", [2.0])]
    assert tuple(incremental.index_stats(chunks.select("path").distinct(), chunks).first()) == (1, 2)
    held = spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string")
    edits = held.select("path", F.when(F.col("path") == "a", F.sha2("text", 256)).otherwise("stale").alias("base_sha"), F.lit("new").alias("text"))
    saved, conflicts = incremental.save_if_unchanged(held, edits)
    assert values(saved, "path", "text") == [("a", "new"), ("b", "two")] and values(conflicts, "path", "current") == [("b", "two")]


def test_triples_keep_their_order(spark):
    reply = json.dumps([{"source": f"s{i}", "relation": "r", "target": f"t{i}", "evidence": "e", "confidence": "0.5", "source_chunk_id": "k"} for i in range(3)])
    found, _ = knowledge.parse_triples(spark.createDataFrame([(0, ["k"], reply), (1, ["k"], reply)], "ord int, batch_ids array<string>, reply string"))
    assert [r["source"] for r in found.orderBy("ord").collect()] == ["s0", "s1", "s2"] * 2
    assert found.select("ord").distinct().count() == 6


def test_untouched_buckets_stay(spark, tmp_path):
    schema = "path string, version long, text string"
    encode = lambda df: df.withColumn("vec", F.array(F.lit(1.0).cast("float")))
    first = [(f"n{i}.md", 1, f"note {i}") for i in range(12)]
    for batch in (first, [("n3.md", 2, "changed"), ("n4.md", 2, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "changes"))
        index_stream.follow(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint"), encode, once=True, buckets=64).awaitTermination()
    want = sorted((f"n{i}.md", "changed" if i == 3 else f"note {i}") for i in range(12) if i != 4)
    assert values(index_stream.current(spark, str(tmp_path / "index")), "path", "text") == want
    held = versions.load(spark, str(tmp_path / "index")).parts
    before = versions.load(spark, str(tmp_path / "index"), 0).parts
    assert sum(before.get(b) != x for b, x in held.items()) <= 2 and len(before) > 5


def test_a_new_checkpoint_goes_on_from_what_is_there(spark, tmp_path):
    schema = "path string, version long, text string"
    encode = lambda df: df.withColumn("vec", F.array(F.lit(1.0).cast("float")))
    folder = str(tmp_path / "index")
    for k, batch in enumerate(([("a.md", 1, "one"), ("b.md", 1, "two")], [("c.md", 1, "three")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"changes{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"changes{k}"))
        index_stream.follow(stream, folder, str(tmp_path / f"checkpoint{k}"), encode, once=True).awaitTermination()
    assert values(index_stream.current(spark, folder), "path", "text") == [("a.md", "one"), ("b.md", "two"), ("c.md", "three")]
    assert len(versions.load(spark, folder).marks) == 2


def test_a_batch_counts_once_and_versions_are_vacuumed(spark, tmp_path):
    schema, folder = "path string, version long, text string", str(tmp_path / "index")
    encode = lambda df: df.withColumn("vec", F.array(F.lit(1.0).cast("float")))
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert index_stream.apply_batch(batch(("a.md", 1, "one"), ("b.md", 1, "b")), 0, "s", folder, encode)
    assert not index_stream.apply_batch(batch(("a.md", 1, "again")), 0, "s", folder, encode)
    assert index_stream.apply_batch(batch(("a.md", 2, "two")), 1, "s", folder, encode)
    assert index_stream.apply_batch(batch(("a.md", 1, "other stream")), 0, "t", folder, encode)
    assert values(index_stream.current(spark, folder), "path", "text") == [("a.md", "other stream"), ("b.md", "b")]
    # Two writers from one snapshot: the second has to begin again.
    base = versions.load(spark, folder)
    assert versions.commit(spark, folder, base, base.parts, base.marks) and not versions.commit(spark, folder, base, {}, {})
    there = {p.name for p in (tmp_path / "index").glob("version=*")}
    assert len(there) == 3 and not any("version" in x for x in versions.vacuum(spark, folder, keep=1))
    gone = versions.vacuum(spark, folder, keep=1, grace=0)
    assert [x for x in gone if "version" in x] == sorted(there - versions.load(spark, folder).versions(), key=gone.index) and gone
    assert values(index_stream.current(spark, folder), "path", "text") == [("a.md", "other stream"), ("b.md", "b")]
    assert versions.numbers(spark, folder) == [3]


def test_nested_tree(spark):
    rows = [("w", "b.md", 3), ("w", "A.md", 1), ("w", "dir/deep/x \"q\".md", 2), ("w", "dir/a.md", None), ("w", ".git/c", 1), ("w", "dir/.h", 1), ("v", "é.md", 5), ("v", "é.md", 4)]
    df = spark.createDataFrame(rows, "root string, path string, size long")
    made = {r["root"]: json.loads(r["tree"]) for r in files.nested_tree(df).collect()}
    deep = {"name": "deep", "path": "dir/deep", "type": "folder", "children": [{"name": 'x "q".md', "path": 'dir/deep/x "q".md', "type": "file", "size": 2}]}
    inner = {"name": "dir", "path": "dir", "type": "folder", "children": [deep, {"name": "a.md", "path": "dir/a.md", "type": "file", "size": None}]}
    leaf = lambda name, size: {"name": name, "path": name, "type": "file", "size": size}
    assert made["w"] == {"name": "w", "path": "", "type": "folder", "children": [inner, leaf("A.md", 1), leaf("b.md", 3)]}
    assert made["v"]["children"] == [leaf("é.md", 5)]
    few = json.loads(files.nested_tree(df.where("root = 'w'"), 1).first()["tree"])
    assert few["more"] == 2 and few["children"][0]["more"] == 1 and files.nested_tree(df.where("false")).count() == 0
