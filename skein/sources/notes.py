"""Notes and other files of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx


def _relative(root: str) -> Column:
    """The path below ``root``, whatever scheme the file system adds."""
    plain = root.rstrip("/").split("://")[-1]
    return F.substring_index(F.col("path"), f"{plain}/", -1)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files but those in or of a name that begins with a dot; bytes that are no UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("path"), "content")
    return rows.where(~F.col("path").rlike(r"(^|/)\.")).select("path", tx.utf8(F.col("content")).alias("text"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ns, size) of all notes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(_relative(root).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))
    return rows.where(tx.is_note(F.col("path")))


def read(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """(path, mtime_ns, size, sha, text) of all notes, or of the paths in ``only``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(_relative(root).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")
    rows = rows.where(tx.is_note(F.col("path")))
    if only is not None:
        rows = rows.join(only.select("path"), "path", "left_semi")
    return rows.select("path", "mtime_ns", "size", F.sha2("content", 256).alias("sha"), tx.utf8(F.col("content")).alias("text"))


def relative_path(path: str) -> str:
    """``path`` within a workspace, with the dots resolved; raises if it leads out of it."""
    parts: list[str] = []
    for part in path.strip("/").split("/"):
        if part == ".." and not parts:
            raise ValueError(f"{path!r} leads out of the folder")
        if part == "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)
