"""Vectors of page images, kept in step with their files.

An injected renderer makes the images of a file's pages, an injected encoder their vectors, in batches. Both are
dear, so neither is called twice for the same bytes: files whose digest the index has are not rendered again, and
images whose digest it has are not encoded again; of equal images one is encoded. What is rendered is
written once to the checkpoint folder, since Spark would otherwise render it again for each use.

Tables: ``pages`` (file, page, digest, file_digest) and ``vectors`` (digest, vec). Image bytes are shuffled once, by
digest and without copies as far as a task sees them; page rows carry digests alone. A file that cannot be
rendered is a row of ``failures`` (file, reason), keeps no pages, and is tried again by the next build. Null content is
that of an empty file; of rows with one path the one with the least digest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.lineage import cut

#: The images of a file's pages, in order.
Renderer = Callable[[bytes], list[bytes]]
#: A matrix with a row per image.
Encoder = Callable[[list[bytes]], np.ndarray]
BATCH = 64


@dataclass
class PageImages:
    pages: DataFrame
    vectors: DataFrame
    failures: DataFrame

    def images(self) -> DataFrame:
        """(file, page, vec), as the multimodal search takes them."""
        return self.pages.join(self.vectors, "digest").select("file", "page", "vec")


def _rendered(files: DataFrame, render: Renderer) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, digest, content in zip(frame["path"], frame["file_digest"], frame["content"], strict=True):
                try:
                    rows = [(path, digest, n, image, None) for n, image in enumerate(render(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  a file that cannot be read must not end the job
                    rows = [(path, digest, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["file", "file_digest", "page", "image", "reason"], dtype=object)
                yield out

    return files.select("path", "file_digest", "content").mapInPandas(run, "file string, file_digest string, page int, image binary, reason string")


def _encoded(images: DataFrame, encode: Encoder) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                vectors = np.asarray(encode([bytes(x) for x in part["image"]]), np.float32)
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "vec": list(vectors)})

    return images.select("digest", "image").mapInPandas(run, "digest string, vec array<float>")


def build(files: DataFrame, render: Renderer, encode: Encoder, old: PageImages | None = None) -> PageImages:
    """The index of ``files`` (path, content). Pages of files that are gone, and their vectors, are dropped."""
    content = F.coalesce("content", F.lit(b""))
    marked = files.select("path", content.alias("content"), F.sha2(content, 256).alias("file_digest"))
    names = marked.groupBy("path").agg(F.min("file_digest").alias("file_digest"))
    one = marked.join(names, ["path", "file_digest"], "left_semi").dropDuplicates(["path"])
    kept = old.pages.join(names.withColumnRenamed("path", "file"), ["file", "file_digest"], "left_semi") if old else None
    # A file without pages has no row in the index and is rendered again, which costs nothing.
    new = one.join(kept.select(F.col("file").alias("path")).distinct(), "path", "left_anti") if kept is not None else one
    made = cut(_rendered(new, render).withColumn("digest", F.sha2("image", 256)))
    failures = made.where(F.col("reason").isNotNull()).select("file", "reason")
    pages = made.where(F.col("reason").isNull()).select("file", "page", "digest", "file_digest")
    if kept is not None:
        pages = kept.select(pages.columns).unionByName(pages)
    images = made.where(F.col("reason").isNull()).select("digest", "image").dropDuplicates(["digest"])
    if old:
        images = images.join(old.vectors.select("digest"), "digest", "left_anti")
    vectors = cut(_encoded(images, encode))
    if old:
        vectors = old.vectors.join(pages.select("digest"), "digest", "left_semi").unionByName(vectors)
    return PageImages(pages, vectors, failures)
