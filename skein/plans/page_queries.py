"""Queries on web pages: scans of their bytes, providers in turn, and vectors of page images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import providers
from skein.plans.registry import Catalog
from skein.sources import page_images, web_pages
from skein.sources.tables import load

catalog = Catalog()
#: Characters of a page that make an image.
WINDOW = 1000


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes (page_id, url, html, content, content_type, status): each fourth in UTF-16, one no text, one refused."""
    rows = load(spark, sf_dir, "pages")
    turn, html = F.col("page_id") % 4, F.coalesce("html", F.lit(""))
    content = F.when(turn == 0, F.encode(html, "UTF-16LE")).otherwise(F.encode(html, "UTF-8"))
    kind = F.when(turn == 0, "Text/Plain; charset=utf-16le").when(turn == 2, "image/png").otherwise("text/html; charset=none-such")
    return rows.select("page_id", "url", "html", content.alias("content"), kind.alias("content_type"), F.when(turn == 3, 403).alias("status"))


@catalog.add(
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, page_id % 4 AS turn FROM pages),
s AS (SELECT *, CASE WHEN turn = 0 THEN 2 * length(html) + 2 * length(regexp_replace(html, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) ELSE strlen(html) END AS n FROM p)
SELECT page_id, CASE turn WHEN 0 THEN 'text/plain' WHEN 2 THEN 'image/png' ELSE 'text/html' END AS kind, n::BIGINT AS n_bytes, n > {web_pages.MAX_BYTES} AS truncated,
CASE turn WHEN 2 THEN '(image/png, ' || n || ' bytes - not text, not shown)' WHEN 3 THEN NULL ELSE html END AS text, CASE WHEN turn = 3 THEN 'refused with HTTP 403' END AS reason FROM s"""
)
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as their own source; their numbers stand for the addresses, which need not be distinct."""
    pages = fetched(spark, sf_dir).withColumn("url", F.col("page_id").cast("string"))
    return web_pages.scan(pages, "html").select(F.col("url").cast("long").alias("page_id"), "kind", "n_bytes", "truncated", "text", "reason")


def _mirror(page_id: int, html: str | None) -> tuple[dict[str, str], None]:
    """A stand-in for a second provider, which has used up its quota for every eighth page."""
    if page_id % 8 == 3:
        raise ValueError("no quota")
    return {"title": "", "kind": "text/html", "text": html or ""}, None


@catalog.add(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 4 != 3 THEN 'direct' WHEN page_id % 8 != 3 THEN 'mirror' END AS provider,
md5(CASE WHEN page_id % 4 = 2 THEN '(image/png, ' || strlen(html) || ' bytes - not text, not shown)' WHEN page_id % 8 != 3 THEN html END) AS digest,
CASE WHEN page_id % 4 != 3 THEN '' WHEN page_id % 8 != 3 THEN 'direct: refused with HTTP 403' ELSE 'direct: refused with HTTP 403; mirror: ValueError: no quota; archive: no results' END AS reasons FROM p"""
)
def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the first provider refuses go to a second, and those that this cannot give to a third, which has none."""
    pages = fetched(spark, sf_dir)
    kind = "struct<title: string, kind: string, text: string>"
    ranked = [
        ("direct", web_pages.provider("html")),
        ("mirror", providers.calling(_mirror, ["page_id", "html"], kind)),
        ("archive", providers.calling(lambda key: None, ["key"], kind)),
    ]
    found = providers.first_answer(pages.withColumn("key", F.col("page_id").cast("string")), ranked)
    return found.select(F.col("key").cast("long").alias("page_id"), "provider", F.md5("answer.text").alias("digest"), F.array_join("reasons", "; ").alias("reasons"))


def windows(content: bytes) -> list[bytes]:
    """A stand-in for a renderer: each WINDOW characters of a page."""
    text = content.decode()
    return [text[i : i + WINDOW].encode() for i in range(0, len(text), WINDOW)]


def ink(images: list[bytes]) -> np.ndarray:
    """A stand-in for an encoder: bytes, opening brackets and blanks of each image."""
    return np.array([(len(x), x.count(b"<"), x.count(b" ")) for x in images], np.float32).reshape(len(images), 3)


@catalog.add(
    f"""WITH p AS (SELECT page_id, html, unnest(generate_series(1, length(html), {WINDOW})) AS s FROM pages WHERE html IS NOT NULL),
w AS (SELECT page_id, (s // {WINDOW} + 1)::INT AS page, substr(html, s, {WINDOW}) AS t FROM p)
SELECT page_id, page, sha256(t) AS digest, strlen(t)::BIGINT AS n_bytes, (length(t) - length(replace(t, '<', '')))::BIGINT AS n_marks, (length(t) - length(replace(t, ' ', '')))::BIGINT AS n_blanks FROM w"""
)
def page_image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all pages, brought up to date from one that has half of them and a page that is gone."""
    files = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    before = files.where(F.crc32("path") % 2 == 0).unionByName(files.select(F.concat(F.lit("gone "), "path").alias("path"), F.lit(b"x").alias("content")))
    index = page_images.build(files, windows, ink, page_images.build(before, windows, ink))
    vec = F.col("vec")
    counts = (vec[i].cast("long").alias(name) for i, name in enumerate(("n_bytes", "n_marks", "n_blanks")))
    return index.pages.join(index.vectors, "digest").select(F.col("file").cast("long").alias("page_id"), "page", "digest", *counts)
