"""Pages of documents: text files, and files that an injected extractor reads page by page.

There is no PDF or OCR library among the requirements; both are callables. OCR results are kept in a
cache table, keyed by the image and the instructions, so that no page is paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx

#: (page number, text layer, image) of each page of a file's bytes.
Extractor = Callable[[bytes], list[tuple[int, str, bytes]]]
#: Text, input tokens, output tokens and whether the limit was reached, for an image in n strips.
Reader = Callable[[bytes, int], tuple[str, int, int, bool]]


def text_pages(files: DataFrame) -> DataFrame:
    """(file, page, text, method) of text files (path, content): one page each."""
    return files.select(F.col("path").alias("file"), F.lit(1).alias("page"), tx.normalize(tx.utf8(F.col("content"))).alias("text"), F.lit("text").alias("method"))


def scanned_pages(files: DataFrame, extract: Extractor) -> DataFrame:
    """(file, page, text, image) of files (path, content); no page is dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, number, text, image) for path, content in zip(frame["path"], frame["content"], strict=True) for number, text, image in extract(bytes(content))]
            yield pd.DataFrame(rows, columns=["file", "page", "text", "image"])

    return files.select("path", "content").mapInPandas(run, "file string, page int, text string, image binary")


def cache_key(image: Column, role: str, prompt: str) -> Column:
    return F.substring(F.sha2(F.concat(image, F.encode(F.lit(role + prompt), "UTF-8")), 256), 1, 32)


def read_images(images: DataFrame, reader: Reader, strips: int = 1) -> DataFrame:
    """(key, text, input_tokens, output_tokens, truncated) of images (key, image).

    An image whose reading reaches the limit is read again in twice as many strips; the costs of both
    readings add up.
    """

    def run(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                read = [reader(bytes(i), n) for i in frame["image"]]
                yield pd.concat([frame[["key"]].reset_index(drop=True), pd.DataFrame(read, columns=["text", "input_tokens", "output_tokens", "truncated"])], axis=1)

        return rows

    schema = "key string, text string, input_tokens long, output_tokens long, truncated boolean"
    first = images.select("key", "image").mapInPandas(run(strips), schema)
    again = images.join(first.where("truncated").select("key"), "key", "left_semi").select("key", "image").mapInPandas(run(2 * strips), schema)
    second = again.select("key", *(F.col(c).alias(f"_{c}") for c in ("text", "input_tokens", "output_tokens", "truncated")))
    joined = first.join(second, "key", "left")
    total = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    return joined.select("key", F.coalesce("_text", "text").alias("text"), total("input_tokens"), total("output_tokens"), F.coalesce("_truncated", "truncated").alias("truncated"))


def with_ocr(pages: DataFrame, cache: DataFrame, reader: Reader, role: str, prompt: str) -> tuple[DataFrame, DataFrame]:
    """(pages, cache): pages whose text layer is too thin get their image's text.

    ``cache`` is (key, text, input_tokens, output_tokens, truncated). Of equal images one is read.
    """
    text = tx.normalize(F.coalesce("text", F.lit("")))
    marked = pages.withColumn("text", text).withColumn("key", F.when(tx.needs_ocr(F.col("text")) & F.col("image").isNotNull(), cache_key(F.col("image"), role, prompt)))
    wanted = marked.where("key is not null").select("key", "image").dropDuplicates(["key"])
    fresh = read_images(wanted.join(cache.select("key"), "key", "left_anti"), reader).withColumn("cached", F.lit(False))
    known = cache.withColumn("cached", F.lit(True)).unionByName(fresh)
    found = known.select("key", *(F.col(c).alias(f"ocr_{c}") for c in ("text", "input_tokens", "output_tokens", "truncated", "cached")))
    joined = marked.drop("image").join(found, "key", "left")
    method = F.when(F.col("key").isNotNull(), "ocr").when(tx.needs_ocr(F.col("text")), "native, no image").otherwise("native")
    out = joined.withColumn("method", method).withColumn("text", F.coalesce("ocr_text", "text")).drop("ocr_text", "key")
    return out, known.drop("cached")
