"""Page scans, providers in turn and page images, with fakes that count their calls."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import html
from skein.operators import providers
from skein.plans import retrieval
from skein.sources import page_images, web_pages

PAGES = "url string, content binary, content_type string, status int"
TEXT = "<html><title>Straße</title><main><h1>Grün</h1><p>" + "naïve café 😀 " * 30 + '<a href="x">mehr</a></p></main></html>'


def test_charset_cap_and_form(spark):
    charsets, caps = ["utf-8", "UTF-16", "'utf-16-le'", "iso-8859-15", "none-such", "hex"], [0, 1, 2, 3, 57, 58, 59, 60, 10**6]
    encodings = {"'utf-16-le'": "utf-16-le", "none-such": "utf-8", "hex": "utf-8"}
    rows = [(f"http://a/{i}", TEXT.encode(encodings.get(c, c), "ignore"), f"text/html; charset={c}", 200) for i, c in enumerate(charsets)]
    df = spark.createDataFrame(rows, PAGES)
    for form, cap in itertools.product(web_pages.FORMS, caps):
        for r in web_pages.scan(df, form, cap).collect():
            _, content, kind, _ = rows[int(r["url"][-1])]
            name = encodings.get(kind.split("=")[1], kind.split("=")[1])
            body, cut = content[:cap], len(content) > cap
            while cut and body:  # the longest prefix of whole characters
                try:
                    body.decode(name)
                    break
                except UnicodeDecodeError:
                    body = body[:-1]
            whole = body.decode(name)
            want = {"html": whole, "text": html.to_text(whole), "markdown": html.to_markdown(whole, r["url"])[1]}[form]
            assert (r["text"], r["truncated"], r["n_bytes"], r["reason"], r["kind"]) == (want, cut, len(content), None, "text/html"), (form, cap, name)
    with pytest.raises(ValueError, match="form"):
        web_pages.scan(df, "pdf")


def test_kinds_refusals_and_nulls(spark):
    shell = b"<html>" + b"<script>x</script>" * 400
    rows = [
        ("1", None, None, None),
        ("2", b"a\xffb", "text/plain", 200),
        ("3", b"%PDF", "application/pdf; x=1", 200),
        ("4", b"\x00" * 9, "image/png", 200),
        ("5", b"body", "text/html", 429),
        ("6", b'{"a": 1}', "application/LD+json", 404),
        ("7", shell, "text/html", 200),
        ("8", shell, "application/xhtml+xml", 200),
        (None, b"", "", 200),
    ]
    found = {r["url"]: (r["kind"], r["text"], r["reason"]) for r in web_pages.scan(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()}
    assert found == {
        "1": ("unknown", "", None),
        "2": ("text/plain", "a�b", None),
        "3": ("application/pdf", None, "the page is a PDF"),
        "4": ("image/png", "(image/png, 9 bytes - not text, not shown)", None),
        "5": ("text/html", None, "refused with HTTP 429"),
        "6": ("application/ld+json", '{"a": 1}', None),
        "7": ("text/html", "", "the page needs scripts"),
        "8": ("application/xhtml+xml", "", None),
        None: ("unknown", "", None),
    }
    assert web_pages.scan(spark.createDataFrame([], PAGES)).count() == 0


def _noted(path, name, rule):
    def ask(key):
        with open(path, "a") as log:
            log.write(f"{name} {key}\n")
        return rule(key)

    return name, providers.calling(ask, ["key"])


def _raise(text):
    raise OSError(text)


def test_later_providers_see_what_is_open(spark, tmp_path):
    log = tmp_path / "calls"
    ranked = [
        _noted(log, "a", lambda k: f"a{k}" if k in (1, 2) else ("weak a", "thin") if k == 3 else _raise("down")),
        _noted(log, "b", lambda k: ("weak b", "thin") if k in (3, 4) else f"b{k}" if k == 5 else ""),
        _noted(log, "c", lambda k: None),
    ]
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 6, None)], "key long").withColumn("answer", F.lit("clash"))
    found = {r["key"]: (r["provider"], r["answer"], r["reasons"]) for r in providers.first_answer(df, ranked).collect()}
    down, thin, none = "a: OSError: down", "b: thin", "c: no results"
    assert found == {
        1: ("a", "a1", []),
        2: ("a", "a2", []),
        3: ("a", "weak a", ["a: thin", thin, none]),
        4: ("b", "weak b", [down, thin, none]),
        5: ("b", "b5", [down]),
        6: (None, None, [down, "b: no results", none]),
        None: (None, None, [down, "b: no results", none]),
    }
    calls = log.read_text().split("\n")[:-1]
    assert len(calls) == len(set(calls)) and {x[0] for x in calls} == set("abc") and len(calls) == 7 + 5 + 4
    assert providers.first_answer(df.limit(0), ranked).count() == 0
    with pytest.raises(ValueError, match="provider"):
        providers.first_answer(df, [])


def test_providers_against_a_loop(spark):
    rng = random.Random(5)
    rule = {(p, k): rng.choice(["good", "", None, "weak", "raise"]) for p in "abcd" for k in range(120)}

    def ask(p):
        return lambda k: _raise("x") if rule[p, k] == "raise" else (f"{p}{k}", "weak") if rule[p, k] == "weak" else rule[p, k] and f"{p}{k}"

    want = {}
    for k in range(120):
        spare, reasons = (None, None), []
        for p in "abcd":
            got = rule[p, k]
            if got == "good":
                spare = (p, f"{p}{k}")
                break
            spare = (p, f"{p}{k}") if got == "weak" and spare[0] is None else spare
            reasons.append(f"{p}: " + {"raise": "OSError: x", "weak": "weak"}.get(got, "no results"))
        want[k] = (*spare, reasons)
    out = providers.first_answer(spark.range(120).withColumnRenamed("id", "key"), [(p, providers.calling(ask(p), ["key"])) for p in "abcd"])
    assert {r["key"]: (r["provider"], r["answer"], r["reasons"]) for r in out.collect()} == want


def test_pages_and_images_are_made_once(spark, tmp_path):
    log = tmp_path / "calls"

    def render(content):
        with open(log, "a") as f:
            f.write("render\n")
        if content == b"bad":
            raise OSError("no page")
        return [x for x in content.split(b"|") if x]

    def encode(images):
        with open(log, "a") as f:
            f.write("".join(f"encode {x.decode()}\n" for x in images))
        return np.array([(len(x), x[0]) for x in images])

    def made():
        calls = log.read_text().split("\n")[:-1]
        log.write_text("")
        return calls.count("render"), sorted(x for x in calls if x != "render")

    def table(rows):
        return spark.createDataFrame(rows, "path string, content binary").withColumn("page", F.lit(0))

    def images(index):
        return sorted((r["file"], r["page"], tuple(r["vec"])) for r in index.images().collect())

    first = page_images.build(table([("a", b"x|yy"), ("b", b"yy|x"), ("c", b"bad"), ("d", None)]), render, encode)
    assert images(first) == [("a", 1, (1, 120)), ("a", 2, (2, 121)), ("b", 1, (2, 121)), ("b", 2, (1, 120))]
    assert [tuple(r) for r in first.failures.collect()] == [("c", "OSError: no page")]
    assert images(first) and made() == (4, ["encode x", "encode yy"])
    second = page_images.build(table([("a", b"x|yy"), ("b", b"zzz|x"), ("c", b"yy"), ("a", b"x|yy")]), render, encode, first)
    assert images(second) == [("a", 1, (1, 120)), ("a", 2, (2, 121)), ("b", 1, (3, 122)), ("b", 2, (1, 120)), ("c", 1, (2, 121))]
    assert made() == (2, ["encode zzz"]) and second.failures.count() == 0
    third = page_images.build(table([("b", b"zzz|x")]), render, encode, second)
    assert images(third) == [("b", 1, (3, 122)), ("b", 2, (1, 120))] and third.vectors.count() == 2 and made() == (0, [])
    assert images(page_images.build(table([]), render, encode, third)) == []


def test_multimodal_search_reads_the_index(spark):
    encode = lambda images: np.array([[x == b"cat", x == b"dog"] for x in images], np.float32)
    index = page_images.build(spark.createDataFrame([("f", b"cat|dog")], "path string, content binary"), lambda b: b.split(b"|"), encode)
    passages = spark.createDataFrame([(1, "f", 2, "one"), (2, "f", 1, "two")], "id long, file string, page int, text string")
    vectors = lambda df: df.withColumn("vec", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>"))
    seen = lambda df: df.withColumn("vec", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>"))
    searcher = retrieval.Searcher(vectors(passages), vectors, images=index.images(), encode_image_query=seen)
    hits = searcher.search(spark.createDataFrame([(1, "a dog")], "qid long, text string"), "multimodal", 2).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [1, 2] and hits[0]["score"] > hits[1]["score"]  # the first in both lists


def test_pages_are_scanned_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(web_pages, "PAGES", 2)
    pages = [(str(i), f"<p>é{i}</p>".encode() if i != 3 else None, "text/html" if i != 4 else "image/png", 403 if i == 5 else None) for i in range(7)]
    found = web_pages.scan(spark.createDataFrame(pages, "url string, content binary, content_type string, status int").coalesce(1), "html")
    text = lambda i: {3: "", 4: "(image/png, 10 bytes - not text, not shown)", 5: None}.get(i, f"<p>é{i}</p>")
    want = [(str(i), text(i), 0 if i == 3 else 10) for i in range(7)]
    assert sorted((r["url"], r["text"], r["n_bytes"]) for r in found.collect()) == want
