"""Operators on literal cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import actions, html
from skein.functions import text as tx
from skein.operators import bm25, chunking, dense, entity_graph, evaluation, files, fusion, incremental, knowledge, notes, rules, trace
from skein.plans.retrieval import Searcher, search_notes
from skein.sources import documents, index_store, trace_store
from skein.sources import notes as note_files
from skein.streaming import index as index_stream
from skein.streaming import usage

PASSAGES = [
    (0, "carbon.pdf", 1, "The carbon tax per tonne rises every year and the carbon price is set per tonne"),
    (1, "carbon.pdf", 2, "Emission trading began in Europe and covers many plants"),
    (2, "rail.pdf", 1, "The rail line of Bangkok Metro opened last spring"),
    (3, "rail.pdf", 2, "Tickets are cheap and trains are frequent"),
    (4, "city.pdf", 1, "Bangkok Metro plans a new depot near the river"),
    (5, "city.pdf", 2, "Parks and gardens were planted along the canal"),
]


@pytest.fixture(scope="module")
def searcher(spark):
    passages = dense.hash_embed(spark.createDataFrame(PASSAGES, "id long, file string, page int, text string"))
    images = spark.createDataFrame([("carbon.pdf", 1, [1.0, 0.0]), ("city.pdf", 2, [0.0, 1.0])], "file string, page int, vec array<float>")
    seen = lambda q: q.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))

    def model(prompts):
        reply = F.when(F.col("prompt").contains("numbered passages"), F.lit('{"relevant": [1, 2]}')).otherwise(F.lit('sure {"query": "carbon tax", "keywords": true}'))
        return prompts.select("qid", reply.alias("reply"))

    return Searcher(passages, lambda q: dense.hash_embed(q), images=images, encode_image_query=seen, model=model)


@pytest.mark.parametrize("kind", ["dense", "bm25", "hybrid", "graph", "agentic", "corrective", "multimodal", "agentic-llm", "corrective-llm"])
def test_all_types_find_the_passage(spark, searcher, kind):
    hits = searcher.search(spark.createDataFrame([(1, "carbon tax per tonne"), (2, "trains and tickets")], "qid long, text string"), kind, 3).collect()
    first = {r["qid"]: r["id"] for r in hits if r["rank"] == 1}
    assert first[1] == 0
    assert len([r for r in hits if r["qid"] == 1]) == 3
    if kind not in ("multimodal", "agentic-llm", "corrective-llm"):
        assert first[2] == 3


def test_search_errors(spark, searcher):
    queries = spark.createDataFrame([(1, "x")], "qid long, text string")
    bare = Searcher(searcher.passages, searcher.encode)
    for kind in ("nearest", "agentic-llm", "multimodal"):
        with pytest.raises(ValueError):
            bare.search(queries, kind)


def test_entity_graph(spark):
    df = spark.createDataFrame([(p[0], p[3]) for p in PASSAGES], "id long, text string")
    assert sorted(map(tuple, entity_graph.edges(df).collect())) == [(0, 2), (2, 0), (2, 4), (4, 2)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "aa aa cc"), (2, "dd")], "id long, text string")
    rows = bm25.search(spark.createDataFrame([(7, "aa aa"), (8, "zz")], "qid long, text string"), docs, 3).collect()
    idf, avg = np.log(1 + 1.5 / 2.5), 2.0
    by_hand = lambda tf, n: round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)), 6)
    assert [(r["rank"], r["id"], r["score"]) for r in rows if r["qid"] == 7] == [(1, 1, by_hand(2, 3)), (2, 0, by_hand(1, 2)), (3, 2, 0.0)]
    assert [(r["id"], r["score"]) for r in rows if r["qid"] == 8] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    few = bm25.search(spark.createDataFrame([(7, "dd")], "qid long, text string"), docs, 3, bm25.FULL_TEXT).collect()
    assert [(r["id"], r["score"] > 0) for r in few] == [(2, True)]


@pytest.mark.parametrize("profile", [bm25.OKAPI, bm25.FULL_TEXT])
def test_bm25_blocks_agree_with_postings(spark, monkeypatch, profile):
    monkeypatch.setattr(bm25, "PASSAGES", 16)
    monkeypatch.setattr(bm25, "QUERIES", 3)
    monkeypatch.setattr(bm25, "CELLS", 40)
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice(["aa", "bb_cc", "dd", "ee", "ff", "zz1"]) for _ in range(n))
    rows = [(i, draw.choice([None, "", "aa bb_cc", "dd", text(5), text(9)])) for i in draw.sample(range(500), 150)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", text(i % 4 + 1)) for i in range(8)] + [("none", "yy"), ("null", None)], "qid string, text string")
    found = bm25.scored(queries, docs, profile, k=4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() < bm25.scored(queries, docs, profile).count()
    built = bm25.index(docs, profile)
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(bm25.scored(queries, docs, profile)) == listed(bm25.scored(queries, docs, profile, built))
    assert listed(bm25.search(queries, docs, 4, profile)) == listed(bm25.search(queries, docs, 4, profile, built))


def test_dense_blocks_by_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(4)
    vectors = draw.integers(-3, 4, (90, 5)).astype(np.float32)
    corpus = spark.createDataFrame([(i * 7 % 90, vectors[i * 7 % 90].tolist()) for i in range(90)], "id long, vec array<float>").repartition(3)
    queries = corpus.where("id % 4 = 0").withColumnRenamed("id", "qid").repartition(5)
    want = [(q, r + 1, int(i)) for q in range(0, 90, 4) for r, i in enumerate(np.lexsort((np.arange(90), -(vectors @ vectors[q])))[:6])]
    for block, few in ((4096, 100), (8, 100), (8, 3)):
        monkeypatch.setattr(dense, "BLOCK", block)
        monkeypatch.setattr(dense, "AT_ONCE", 3)
        monkeypatch.setattr(dense, "BROADCAST_QUERIES", few)
        found = dense.search(queries, corpus, 6)
        # A few queries do not read the corpus again for each of their partitions.
        assert ("CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()) == (few == 3)
        assert sorted((r["qid"], r["rank"], r["id"]) for r in found.collect()) == want


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "qid long, rank int, id long") for ids in ([1, 2, 3], [3, 1, 9])]
    assert [r["id"] for r in fusion.fuse(lists, 2).orderBy("rank").collect()] == [1, 3]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=6))
def test_windows(spark, sizes):
    df = spark.createDataFrame([(i, " ".join(map(str, range(n)))) for i, n in enumerate(sizes)], "id long, text string")
    wanted = []
    for i, n in enumerate(sizes):
        for start in range(0, n, 220):
            wanted.append((i, start, min(260, n - start)))
            if start + 260 >= n:
                break
    assert sorted((r["id"], r["start"], r["n_words"]) for r in chunking.windows(df, ["id"]).collect()) == wanted


def test_markdown_sections():
    text = "---\ntitle: x\n---\n\n# A\nintro\n```\n# not a heading\n```\n## B ##\nb\n# C\n"
    found = [(c["heading"], c["ord"], c["line"], c["text"]) for c in chunking.markdown_chunks(text)]
    assert found == [("A", 0, 5, "# A\nintro\n```\n# not a heading\n```"), ("A > B", 1, 10, "## B ##\nb"), ("C", 2, 12, "# C")]
    long = "# T\n" + "\n\n".join(" ".join(["word"] * 80) for _ in range(5))
    parts = chunking.markdown_chunks(long)
    assert [c["text"].count("word") for c in parts] == [160, 160, 80] and [c["line"] for c in parts] == [1, 6, 10]


def test_text_functions(spark):
    rows = [("ab_c d Été x1 กำ ๑๒", "  a \t b\n\n\n\nc ", "The Data-Retention  Plan", "Dr. Smith met Anna. NATO")]
    r = spark.createDataFrame(rows, "a string, b string, c string, d string").select(
        tx.tokens(F.col("a")).alias("tokens"), tx.full_text_tokens(F.col("a")).alias("full"), tx.normalize(F.col("b")).alias("plain"), tx.entity_key(F.col("c")).alias("key"), tx.entities(F.col("d")).alias("names"),
        tx.numbers(F.lit("1,475.0 and ๒5")).alias("numbers"), tx.truncate(F.lit("abcdefghij"), 4).alias("cut"), tx.stem(F.lit("a/b/Note.MD")).alias("stem"), tx.wikilinks(F.lit("[[A#x|y]] [[b/c]]")).alias("links"),
        tx.charset(F.lit("text/html; charset='utf-16'")).alias("charset"), tx.without_action(F.lit('so\n```json\n{"tool": 1}\n```')).alias("words"), tx.json_paths(F.lit("<think>[1]</think>```json\n[{}]\n```")).alias("json"),
    ).first()
    assert r["tokens"] == re.findall(r"\b\w\w+\b", rows[0][0].lower().replace("๑๒", "12")) and r["full"] == ["ab", "c", "été", "x1", "กำ", "12"]
    assert r["plain"] == "a b\n\nc" and r["key"] == "data retention plan" and r["names"] == ["Dr. Smith", "Anna. NATO"][::-1]
    assert r["numbers"] == ["1475.0", "25"] and r["cut"] == "ab\n... [truncated 6 chars] ...\nij" and r["stem"] == "note"
    assert r["links"] == ["A", "b/c"] and r["charset"] == "utf-16" and r["words"] == "so" and r["json"] == "[{}]"


def test_knowledge(spark):
    schema = "ord long, source string, relation string, target string, evidence string, confidence double, source_chunk_id string"
    rows = [(0, "A", "to", "B", "", 0.9, "c1"), (1, "B", "to", "C", "because", 0.5, "c2"), (2, "C", "to", "D", "", 0.5, "c3"), (3, "X", "is", "X", "", 0.1, "c4")]
    t = spark.createDataFrame(rows, schema)
    names = spark.createDataFrame([(1, "a"), (2, "the-X")], "qid long, name string")
    start = knowledge.seeds(t, names=names, match="normalized")
    assert sorted(map(tuple, start.collect())) == [(1, "A"), (2, "X")]
    for depth, reached in ((0, "A"), (1, "AB"), (2, "ABC"), (5, "ABCD")):
        nodes, edges = knowledge.subgraph(t, start, depth)
        assert sorted(r["node"] for r in nodes.collect() if r["qid"] == 1) == list(reached)
        assert edges.where("qid = 1").count() == min(depth, 3)
    alias = spark.createDataFrame([("start", "the A")], "name string, alias string")
    asked = spark.createDataFrame([(1, "Start")], "qid long, name string")
    assert [r["node"] for r in knowledge.seeds_by_name(t, asked, "alias", alias).collect()] == ["A"]
    for bad in ({"mode": "fuzzy"},):
        with pytest.raises(ValueError):
            knowledge.seeds_by_name(t, names, **bad)
    named = spark.createDataFrame([(0, "the Storage Box", "in", "project  lotus"), (1, "storage box", "in", "Project-Lotus")], "ord long, source string, relation string, target string")
    given = spark.createDataFrame([(0, "PL", "project lotus")], "ord long, canonical string, variant string")
    assert {tuple(r) for r in knowledge.normalize(named).select("source", "target").collect()} == {("storage box", "Project-Lotus")}
    assert {r["target"] for r in knowledge.normalize(named, given).collect()} == {"PL"}
    reply = '[{"source": "A", "relation": "r", "target": "B", "source_chunk_id": "chunk k1"}, {"source": "A", "relation": "r", "target": "C", "source_chunk_id": "zz"}, {"source": " ", "relation": "r", "target": "C"}]'
    valid, rejected = knowledge.parse_triples(spark.createDataFrame([(0, ["k1", "k2"], reply), (1, ["k3"], "x [{\"source\": \"S\", \"relation\": \"r\", \"target\": \"T\"}] y")], "ord long, batch_ids array<string>, reply string"))
    assert sorted((r["target"], r["source_chunk_id"]) for r in valid.collect()) == [("B", "k1"), ("T", "k3")] and rejected.count() == 2
    empty = knowledge.as_text(t.where("false").withColumn("hop", F.lit(1)).withColumn("qid", F.lit(1)), names)
    assert {r["context"] for r in empty.collect()} == {knowledge.EMPTY_CONTEXT}


def test_links(spark):
    notes_df = spark.createDataFrame([("a/one.md", "see [[two]] and [[Three]]"), ("a/two.md", "x"), ("ab/two.md", "back to [[a/one|first]]"), ("three.md", "[[two]]")], "path string, text string")
    found = notes.links(chunking.sections(notes_df), notes_df)
    assert sorted((r["source"], r["target"]) for r in found.collect()) == [("a/one.md", "a/two.md"), ("a/one.md", "three.md"), ("ab/two.md", "a/one.md"), ("three.md", "a/two.md")]
    assert sorted(r["path"] for r in notes.backlinks(found, "a/two.md").collect()) == ["a/one.md", "three.md"]


def test_notes_search(spark):
    rows = spark.createDataFrame([("a/x.md", "# Budget\ncost of the plan"), ("ab/y.md", "# Other\ncost of living"), ("a/z.md", "# Trees\nforest")], "path string, text string")
    sections = dense.hash_embed(chunking.sections(rows))
    asked = spark.createDataFrame([(1, "cost budget")], "qid long, text string")
    for kind in ("dense", "bm25", "hybrid"):
        hits = search_notes(asked, sections, dense.hash_embed, kind, 5, "a").join(sections.select("id", "path"), "id").orderBy("rank").collect()
        assert hits[0]["path"] == "a/x.md" and all(h["path"].startswith("a/") for h in hits)


def test_html():
    page = '<html><head><title>T &amp; U</title></head><body><nav>menu</nav><main><h2>Head</h2><p>One <a href="/x">link</a> <b>two</b>.</p><ul><li>a<li>b</ul><ol><li>c</ol><pre>x  y</pre><table><tr><th>k</th><td>v</td></tr></table><div hidden>no</div>' + "word " * 60 + "</main><footer>f</footer></body></html>"
    title, body = html.to_markdown(page, "http://h.org/p")
    assert title == "T & U" and body.startswith("## Head\n\nOne [link](http://h.org/x) two.")
    for part in ("- a", "- b", "1. c", "```\nx  y\n```", "| k | v |"):
        assert part in body
    assert not any(x in body for x in ("menu", "no\n", "\nf"))
    assert html.to_markdown("<main>short</main><p>outside</p>")[1] == "short\n\noutside" and html.to_markdown(None) == ("", "")
    assert html.to_markdown("<head><title>T</title><body><p>shown") == ("T", "shown")
    assert html.to_markdown("<ul><li>a<ol><li>b</li></ol></li></ul>")[1] == "- a\n  1. b"
    assert html.to_text('<p>a <a href="/b">c</a> <code>d</code>') == "a c d"
    assert html.to_text("<h2>Head</h2><pre>x\n  y</pre><p>own `ticks` and [b](c) # stay<ul><li>one</ul>") == "Head\n\nx\n  y\n\nown `ticks` and [b](c) # stay\n- one"


def test_actions():
    cases = {
        '```json\n{"tool": "read", "args": {"path": "a"}}\n```': ("read", '{"path": "a"}', None),
        'text {"tool": "bash", "command": "ls", "args": {}} more': ("bash", '{"command": "ls"}', None),
        '{"tool": "a", "x": 1, "args": {"x": 2}}': ("a", '{"x": 2}', None),
        "<function=grep><parameter=pattern> x </parameter></function>": ("grep", '{"pattern": "x"}', None),
        '<tool_call>{"name": "w", "arguments": {"k": "v"}}</tool_call>': ("w", '{"k": "v"}', None),
        "<tool_call><search>\nquery>\n a b \n</parameter></tool_call>": ("search", '{"query": " a b "}', None),
        '<tool_call>{"name": "old"}</tool_call> <tool_call>{"name": "new", "arguments": "{}"}': ("new", "{}", None),
        "nothing": (None, None, actions.NO_ACTION),
        "```json\n{bad\n```": (None, None, "the json block cannot be read"),
        '```json\n{"a": 1}\n```': (None, None, 'the json names no tool'),
    }
    for reply, wanted in cases.items():
        assert actions.parse(reply) == wanted


def test_rules(spark):
    own = rules.with_defaults({"bash": "ask", "read": "allow"}, [rules.Rule("bash", "python3 *", "allow"), rules.Rule("bash", "rm *", "deny")])
    calls = [("bash", "python3 x.py", "allow"), ("bash", "python3 x.py; curl y", "ask"), ("bash", "touch a && rm a", "deny"), ("read", "a", "allow"), ("other", "a", "ask")]
    df = spark.createDataFrame(calls, "tool string, pattern string, wanted string")
    out = df.select("wanted", rules.decide_call(own, F.col("tool"), F.col("pattern"), F.col("tool") == "bash").alias("got")).collect()
    assert [r["got"] for r in out] == [r["wanted"] for r in out]
    with pytest.raises(ValueError):
        rules.Rule("a", "*", "maybe")
    declared = {"path": {"type": "string", "required": True}, "n": {"type": "integer"}, "mode": {"type": "string", "enum": ["r", "w"]}}
    given = [({"path": "a", "n": "3"}, None), ({"n": "3"}, "missing required argument path"), ({"path": "a", "n": "x"}, "n must be a integer"), ({"path": "a", "z": "1"}, "unknown argument z"), ({"path": "a", "mode": "q"}, "mode must be one of r, w")]
    rows = spark.createDataFrame(given, "given map<string,string>, wanted string").select("wanted", rules.validate_args(F.col("given"), declared).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["wanted"] for r in rows]


def test_headings_and_files(spark):
    lines = [("f", 1, 0, "A Large Title", 20.0, False), ("f", 1, 1, "that goes on", 20.0, False), *[("f", 1, i + 2, f"body text number {i} is long enough to be the body", 10.0, False) for i in range(9)], ("f", 2, 0, "Bold head here", 10.0, True)]
    df = spark.createDataFrame(lines, "file string, page int, line int, text string, size double, bold boolean")
    assert [(r["page"], r["text"]) for r in files.headings(df).orderBy("page").collect()] == [(1, "A Large Title that goes on"), (2, "Bold head here")]
    some = spark.createDataFrame([("a/b.md", "x\ny needle\nz"), ("c.txt", "needle")], "path string, text string")
    assert [(r["path"], r["line"]) for r in files.grep(some, "needle").collect()] == [("a/b.md", 2), ("c.txt", 1)]
    assert [(r["line"], r["text"], r["remaining"]) for r in files.read(some, "a/b.md", 2, 1).collect()] == [(2, "y needle", 1)]
    edit = lambda old, every=False: some.where("path = 'c.txt'").select(files.replace_text(F.col("text"), old, "E", every).alias("e")).first()["e"]
    assert edit("needle")["text"] == "E" and edit("e")["error"] and edit("e", True)["text"] == "nEEdlE" and edit("q")["error"]


def test_incremental(spark):
    known = spark.createDataFrame([("a", 1, 1, "s1"), ("b", 1, 1, "s2"), ("c", 1, 1, "s3"), ("d", 1, 1, "s4")], "path string, mtime_ns long, size long, sha string")
    disk = spark.createDataFrame([("a", 1, 1, "s1"), ("b", 2, 1, "s2"), ("c", 2, 1, "new"), ("e", 1, 1, "s5")], known.schema)
    assert {r["path"]: r["status"] for r in incremental.diff(disk, known).collect()} == {"a": "unchanged", "b": "unchanged", "c": "updated", "d": "removed", "e": "added"}
    assert sorted(r["path"] for r in incremental.unread(disk, known).collect()) == ["b", "c", "e"]


def test_transcript(spark):
    schema = "session_id string, id long, step_id string, model string, tool string, args_json string, decision string, ok boolean, model_output string, observation string, tokens long, created_at long"
    rows = [
        ("s", 1, "user", None, None, None, None, True, None, "do it", None, 1), ("s", 2, "act", "m", "read", '{"path": "a"}', "allow", True, 'thinking {"tool": "read"}', "text", 10, 2),
        ("s", 3, "act", "m", "bash", "{}", "deny", False, "", "no", 5, 3), ("s", 4, "act", "n", "final_answer", '{"answer": "done"}', "allow", True, "", "", 7, 4), ("s", 5, "review", "n", None, None, None, True, "VERDICT: PASS", "", 2, 5),
        ("s", 6, "hint", None, None, None, None, True, None, "also this", None, 6), ("s", 7, "act", "m", "bash", "{cut", "allow", False, "", "oops", 1, 7),
    ]
    out = trace.transcript(spark.createDataFrame(rows, schema)).orderBy("message").collect()
    assert [(r["role"], r["kind"]) for r in out] == [("user", "message"), ("assistant", None), ("user", "hint"), ("assistant", None)]
    assert [(p["type"], p["status"]) for p in out[1]["parts"]] == [("reasoning", None), ("tool", "completed"), ("tool", "denied"), ("text", None), ("review", None)]
    assert out[1]["tokens"] == 24 and out[1]["models"] == ["m", "n"] and out[3]["parts"][0]["status"] == "error"


def test_meters(spark):
    steps = spark.createDataFrame([("s", 1, "a", "m", 100), ("s", 2, "a", "m", 3500), ("s", 3, None, "m", 9)], "session_id string, id long, tool string, model string, tokens long")
    for window, percent in ((7000, 50.0), (200000, 1.8)):
        limits = spark.createDataFrame([("m", window, None)], "model string, context_window long, request_tokens long")
        assert trace.context_meter(steps, limits).first()["percent"] == percent
    ids = spark.createDataFrame([("run_001",), ("run_002",)], "id string")
    assert trace.find_session(ids, "002") == "run_002" and trace.find_session(ids, "run_001") == "run_001"
    for text in ("run", "zzz"):
        with pytest.raises(ValueError):
            trace.find_session(ids, text)


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, r, "f", p) for r, p in enumerate((9, 3, 4), 1)], "qid long, rank int, file string, page int")
    gold = spark.createDataFrame([(1, "f", 3), (1, "f", 8), (2, "f", 1)], "qid long, file string, page int")
    out = {r["qid"]: (r["hit5"], r["rr10"], r["gold_found5"]) for r in evaluation.score(hits, gold, ["file", "page"]).collect()}
    assert out == {1: (1, 0.5, 0.5), 2: (0, 0.0, 0.0)}
    rows = [(i, c, s) for i, (c, s) in enumerate([("a", False), ("a", True), ("a", False), ("a", False), ("a", True), ("none", False)])]
    assert sorted(r["id"] for r in evaluation.pick(spark.createDataFrame(rows, "id long, category string, small boolean")).collect()) == [0, 1, 2, 4, 5]
    costs = evaluation.cost(spark.createDataFrame([("read", 10.0), ("embed", 2.0)], "stage string, seconds double"), {"dense": ["read", "embed"], "bm25": ["read"]}, 4.0, {"1 GB": 1000.0}).collect()
    assert {r["type"]: r["seconds_per_mb"] for r in costs} == {"dense": 3.0, "bm25": 2.5}


def test_documents(spark):
    extract = lambda raw: [(1, "thin", raw), (2, "a text layer that is long enough " * 5, b"")]
    pages = documents.scanned_pages(spark.createDataFrame([("f.pdf", bytearray(b"img")), ("g.pdf", bytearray(b"img"))], "path string, content binary"), extract)
    cache = spark.createDataFrame([], "key string, text string, input_tokens long, output_tokens long, truncated boolean")
    reader = lambda image, strips: (f"read in {strips}", 10 * strips, 5, strips == 1)
    out, known = documents.with_ocr(pages, cache, reader, "role", "prompt")
    rows = sorted((r["file"], r["page"], r["method"], r["text"][:9], r["ocr_input_tokens"]) for r in out.collect())
    assert rows == [("f.pdf", 1, "ocr", "read in 2", 30), ("f.pdf", 2, "native", "a text la", None), ("g.pdf", 1, "ocr", "read in 2", 30), ("g.pdf", 2, "native", "a text la", None)]
    again, _ = documents.with_ocr(pages, known.cache(), lambda *_: 1 / 0, "role", "prompt")
    assert {r["ocr_cached"] for r in again.where("method = 'ocr'").collect()} == {True}


def test_stores(spark, tmp_path):
    passages = dense.hash_embed(spark.createDataFrame(PASSAGES, "id long, file string, page int, text string"))
    index_store.save(passages, str(tmp_path / "index"), "hash")
    stored = index_store.load(spark, str(tmp_path / "index"), "hash")
    query = spark.createDataFrame([(1, "carbon tax per tonne")], "qid long, text string")
    fresh = bm25.search(query, passages.select("id", "text"), 3).collect()
    assert bm25.search(query, stored.passages.select("id", "text"), 3, built=stored.words).collect() == fresh
    assert index_store.sizes(spark, str(tmp_path / "index")).count() == 4
    with pytest.raises(ValueError):
        index_store.load(spark, str(tmp_path / "index"), "other")
    path = str(tmp_path / "sessions")
    for row in (("s", 0, "task", None), ("s", 1, None, "x" * 5000)):
        trace_store.append_sessions(spark.createDataFrame([row], "id string, version int, task string, answer string"), path)
    last = trace_store.current(spark.read.parquet(path)).first()
    assert last["task"] == "task" and "truncated 1000 chars" in last["answer"]


def test_note_files(spark, tmp_path):
    for name, body in (("a.md", "# A"), ("sub/b.txt", "b"), ("sub/c.py", "no"), (".hidden/d.md", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert sorted(r["path"] for r in note_files.listing(spark, str(tmp_path)).collect()) == ["a.md", "sub/b.txt"]
    assert {r["path"]: r["text"] for r in note_files.read(spark, str(tmp_path)).collect()} == {"a.md": "# A", "sub/b.txt": "b"}
    assert note_files.relative_path("/a/./b/../c") == "a/c"
    with pytest.raises(ValueError):
        note_files.relative_path("a/../../b")


def test_following_notes(spark, tmp_path):
    schema = "path string, version long, text string"
    encode = lambda df: df.withColumn("vec", F.array(F.lit(1.0).cast("float")))
    for batch in ([("a.md", 1, "# A\none"), ("b.md", 1, "b")], [("a.md", 2, "# A\ntwo"), ("b.md", 2, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "changes"))
        index_stream.follow(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint"), encode, once=True).awaitTermination()
    assert [r["text"] for r in index_stream.current(spark, str(tmp_path / "index")).collect()] == ["# A\ntwo"]
    assert [r["text"] for r in index_stream.current(spark, str(tmp_path / "index"), 0).orderBy("path").collect()] == ["# A\none", "b"]


def test_streamed_repeats(spark, tmp_path):
    rows = [(1, i, a) for i, a in enumerate("aabbb")] + [(2, 9, "a")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("user_id long, event_id long, event_type string").parquet(str(tmp_path / "events"))
    out = usage.drain(usage.repeats(stream), "repeats", "update").collect()
    assert {(r["session"], r["action"], r["length"]) for r in out} == {(1, "b", 3), (2, "a", 1)}
