from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import media, queries


@given(st.binary(min_size=1, max_size=700))
def test_images_are_lossless(data):
    padded = data + bytes(-len(data) % 64)
    assert media.from_png(media.to_png(padded)).tobytes() == padded


def test_sequences():
    page = '<h1>T</h1><p>a <b>b</b><figure><img src="media:AB" alt="x"><figcaption>cap <i>tion</i></figcaption></figure>after<img src="u.png" alt="alt"><script>no</script><div>end</div>'
    items = media.parse(page)
    assert [(i["position"], i["kind"], i["text"] or i["src"], i["caption"]) for i in items] == [
        (0, "text", "T", None), (1, "text", "a b", None), (2, "media", "media:AB", "cap tion"), (3, "text", "after", None), (4, "media", "u.png", "alt"), (5, "text", "end", None),
    ]
    assert items[2]["digest"] == "ab" and items[4]["digest"] is None and media.parse(None) == []


def test_references_resolve_in_place(spark):
    payloads = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string")
    _, stored = media.documents_as_media(payloads)
    known = {r["payload"].rstrip(b"\0").decode(): r["digest"] for r in stored.collect()}
    html = f'<p>x<img src="media:{known["two"]}" alt="2"><p>y<img src="media:{known["one"]}" alt="1"><img src="media:00" alt="?">'
    pages = spark.createDataFrame([(7, html), (8, None), (9, "<p>text")], "page_id long, html string")
    sequences = media.interleave(pages)
    resolved = media.resolve(sequences, media.read_back(media.store(stored)))
    rows = {(r["page_id"], r["position"]): r for r in resolved.collect()}
    assert rows[7, 1]["caption"] == "2" and rows[7, 1]["payload_sha256"] == hashlib.sha256(b"two" + bytes(61)).hexdigest()
    assert rows[7, 4]["payload_bytes"] is None and len(rows) == 3
    items = {r["page_id"]: r["items"] for r in media.align(sequences, resolved).collect()}
    assert [i["media"]["payload_bytes"] if i["media"] else None for i in items[7]] == [None, 64, None, 64, None]
    assert items[8] == [] and len(items[9]) == 1


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_media_columns"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.to_png(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.feature(media.from_png(stored))
        lines = [" ".join(x.split()) for x in raw.decode().split("\n")]
        kept = [x for x in lines if x]
        assert (r["n_items"], r["position"]) == (len(kept) + 1, 1 if lines[0] else 0)
        assert r["items_sha256"] == hashlib.sha256("".join(f"{x}\n" for x in kept).encode()).hexdigest()


def test_pages_as_they_come():
    page = '<html><head><title>no</title><meta name="a"><body><p>one</p><figure><img src="a.png"><figure><img src="b.png"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>'
    page += '<img srcset="s.png 1x, l.png 2x"><img src="data:image/gif;base64,R0lGOA==" alt="d"><img src="data:,a%20b"><img src="data:;base64,?"><p>end'
    items = media.parse(page)
    assert [(i["text"] or i["src"][:8], i["caption"], i["bytes"]) for i in items] == [
        ("one", None, None), ("a.png", "outer", None), ("b.png", "inner", None), ("l.png", None, None),
        ("data:ima", "d", 4), ("data:,a%", None, 3), ("data:;ba", None, None), ("end", None, None),
    ]
    assert items[5]["digest"] == hashlib.sha256(b"a b" + bytes(61)).hexdigest() and items[6]["digest"] is None


def test_real_pages(spark, sf_dir):
    """All text of a page's body is in its items, in order, and each reference at its place."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in media.interleave(pages).collect():
        page = re.sub(r"(?is)<(script|style|template|noscript|title)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", " ", html[r["page_id"]])
        words = unescape(re.sub(r"<[^>]*>", " ", page)).split()
        assert " ".join(x["text"] or "" for x in r["items"] if x["kind"] == "text").split() == words or "figcaption" in page
        assert [x["src"] for x in r["items"] if x["kind"] == "media"] == re.findall(r'(?i)<(?:img|video|audio|source|embed)\b[^>]*?\bsrc="([^"]+)"', page)
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))


def test_repeated_and_null_pages_align(spark):
    raw = "<p>x<img src='data:,one'><p>y"
    pages = spark.createDataFrame([(1, raw), (1, raw), (1, "<img src='data:,two'>"), (None, raw), (None, "<p>z")], "page_id long, html string")
    sequences = media.interleave(pages)
    resolved = media.resolve(sequences, media.read_back(media.store(media.embedded(sequences))))
    rows = media.align(sequences, resolved).collect()
    found = sorted((r["page_id"] or 0, [x["media"]["payload_sha256"][:6] if x["media"] else x["text"] for x in r["items"]]) for r in rows)
    one, two = (hashlib.sha256(x + bytes(61)).hexdigest()[:6] for x in (b"one", b"two"))
    assert sorted(map(str, found)) == sorted(map(str, [(0, ["x", one, "y"]), (0, ["z"]), (1, ["x", one, "y"]), (1, ["x", one, "y"]), (1, [two])]))


def test_payload_of_any_length(spark):
    rows = spark.createDataFrame([(i, "é" * i) for i in range(70)], "doc_id long, text string").select("doc_id", media.payload(F.col("text")).alias("p")).collect()
    assert all(len(r["p"]) == max(64, -(-2 * r["doc_id"] // 64) * 64) for r in rows)


def test_captions_before_their_figure_and_alternatives():
    def found(html):
        return [(x["src"], x["caption"]) if x["kind"] == "media" else x["text"] for x in media.parse(html)]

    assert found('<figure><figcaption>First</figcaption><img src="a" alt="x"><img src="b"></figure><img src="c" alt="y">') == [("a", "First"), ("b", "First"), ("c", "y")]
    assert found('<figure><figcaption> </figcaption><img src="a" alt="x"></figure>') == [("a", "x")]
    assert found('<figure><figcaption>Outer</figcaption><figure><img src="a"></figure><img src="b"></figure>') == [("a", None), ("b", "Outer")]
    picture = '<p>t<picture><source srcset="a 1x, b 2x"><source srcset="c"><img src="d" alt="x"></picture>u</p>'
    assert found(picture) == ["t", ("d", "x"), "u"]
    assert found(picture.replace('src="d" ', "")) == ["t", ("b", None), "u"]
    assert found(picture.replace("</picture>", "")) == ["t", ("d", "x"), "u"]
    assert found('<video src="v"><source src="a"></video><video><source src="a"><source src="b">old</video><source src="c">') == [("v", None), "old", ("a", None), ("c", None)]
    assert found('<picture><source srcset="a">') == [("a", None)] and found("<picture></picture></video>") == []
    assert found('<style><picture><source srcset="a"></picture></style><object data="o"></object><video poster="p"></video>') == []
