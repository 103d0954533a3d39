"""Keeping an index of notes in step with its folder.

``disk`` and ``known`` are (path, mtime_ns, size, sha); ``chunks`` is (id, path, heading, ord, line,
text, vec). Every operator returns the new state; writing it is the sink's part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx


def diff(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): added, updated, removed, or unchanged (by time and size, or else by hash)."""
    old = known.select("path", *(F.col(c).alias(f"old_{c}") for c in ("mtime_ns", "size", "sha")))
    both = disk.withColumn("_on_disk", F.lit(True)).join(old.withColumn("_known", F.lit(True)), "path", "full_outer")
    same_stat = (F.col("mtime_ns") == F.col("old_mtime_ns")) & (F.col("size") == F.col("old_size"))
    status = (
        F.when(F.col("_on_disk").isNull(), "removed")
        .when(F.col("_known").isNull(), "added")
        .when(same_stat | (F.col("sha") == F.col("old_sha")), "unchanged")
        .otherwise("updated")
    )
    return both.select("path", status.alias("status"))


def unread(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a listing (path, mtime_ns, size) that must be read: new ones, and ones that were touched.

    Joining before the content is read keeps unchanged files off the scan.
    """
    return listing.join(known.select("path", "mtime_ns", "size"), ["path", "mtime_ns", "size"], "left_anti")


def counts(statuses: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged."""
    names = ("added", "updated", "removed", "unchanged")
    return statuses.agg(*(F.count_if(F.col("status") == n).alias(n) for n in names))


def upsert(chunks: DataFrame, fresh: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``chunks`` after the notes of ``fresh`` (chunks without vec) were indexed again.

    Chunks of those notes that are not in ``fresh`` go; those that are keep their vector. Only chunks
    without one are handed to ``encode``, which adds ``vec`` to (id, path, heading, ord, line, text).
    """
    columns = ["id", "path", "heading", "ord", "line", "text"]
    rest = chunks.join(fresh.select("path").distinct(), "path", "left_anti")
    reused = fresh.select(*columns).join(chunks.select("id", "vec"), "id", "left")
    new = encode(reused.where("vec is null").drop("vec"))
    return rest.select(*columns, "vec").unionByName(reused.where("vec is not null").select(*columns, "vec")).unionByName(new.select(*columns, "vec"))


def reembed(chunks: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors for chunks that have none, as after a change of the embedder."""
    return chunks.where("vec is not null").unionByName(encode(chunks.where("vec is null").drop("vec")).select(*chunks.columns))


def remove(chunks: DataFrame, path: str) -> DataFrame:
    """Without a file, or without all files of a folder."""
    return chunks.where(~tx.in_folder(F.col("path"), path))


def move(chunks: DataFrame, old: str, new: str) -> DataFrame:
    """After a file or folder was moved: ids follow the path, vectors stay.

    A destination that is no note drops the chunks, and one that was there is replaced.
    """
    moving = tx.in_folder(F.col("path"), old)
    there = F.when(moving, F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path"))
    rows = chunks.withColumn("_moved", moving).withColumn("path", there)
    targets = rows.where("_moved").select("path").distinct()
    stay = rows.where("not _moved").join(targets, "path", "left_anti")
    gone = rows.where("_moved").where(tx.is_note(F.col("path")))
    gone = gone.withColumn("id", tx.chunk_id(F.col("path"), F.col("heading"), F.col("text")))
    return stay.unionByName(gone).select(*chunks.columns)


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def save_if_unchanged(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, conflicts) after ``edits`` (path, base_sha, text): an edit counts only on its base version."""
    current = notes.select("path", F.sha2("text", 256).alias("sha"), F.col("text").alias("current"))
    joined = edits.join(current, "path", "left")
    fits = F.col("base_sha").eqNullSafe(F.col("sha"))
    done = joined.where(fits).select("path", "text")
    return notes.join(done.select("path"), "path", "left_anti").select("path", "text").unionByName(done), joined.where(~fits).select("path", "sha", "current")
