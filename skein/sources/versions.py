"""Tables as snapshots: folders that are written once, and manifests that say which of them are in force.

Data goes to a folder with a random name, so no writer can overwrite what another, or an earlier run, has
written. A manifest lists the parts of the table (name and folder) and marks (name and number: batches that are in,
tokens that are spent). Manifests are numbered; a commit puts the next number if it is absent, by one
rename, and otherwise fails, so of two writers that began from one snapshot one has to begin again. A reader that has
a snapshot keeps it until its folders are vacuumed.

Stores whose rename is atomic (HDFS, local disks) let exactly one of several writers through.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFESTS = "manifest"
VERSION = "version="
DAY = 86_400.0


@dataclass
class Snapshot:
    number: int = -1
    parts: dict[str, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def versions(self) -> set[str]:
        return {x.split("/")[0] for x in self.parts.values()}


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder and when each was changed last, in seconds; none if there is no folder."""
    store, at = _store(spark, folder), _path(spark, folder)
    return {x.getPath().getName(): x.getModificationTime() / 1000 for x in store.listStatus(at)} if store.exists(at) else {}


def _put_if_absent(spark: SparkSession, written: str, final: str) -> bool:
    """Rename ``written`` to ``final``, unless that is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    if _store(spark, final).exists(_path(spark, final)):
        return False
    home = _store(spark, final).getUri()
    files = hadoop.FileContext.getFileContext(home, spark._jsc.hadoopConfiguration())
    try:
        files.rename(_path(spark, written), _path(spark, final), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        if _store(spark, final).exists(_path(spark, final)):
            return False
        raise
    return True


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The snapshots there are, oldest first."""
    return sorted(int(m[1]) for x in _entries(spark, f"{folder}/{MANIFESTS}") if (m := re.fullmatch(r"number=(\d+)", x)))


def load(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The newest snapshot, or that of a number; an empty one if there is none yet."""
    known = numbers(spark, folder)
    if not known and number is None:
        return Snapshot()
    at = known[-1] if number is None else number
    rows = spark.read.schema("kind string, name string, value string").parquet(f"{folder}/{MANIFESTS}/number={at:08d}").collect()
    return Snapshot(at, {r["name"]: r["value"] for r in rows if r["kind"] == "part"}, {r["name"]: int(r["value"]) for r in rows if r["kind"] == "mark"})


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write of Spark's to the folder has ended well."""
    return "_SUCCESS" in _entries(spark, folder)


def new_version() -> str:
    return f"{VERSION}{uuid.uuid4().hex}"


def commit(spark: SparkSession, folder: str, after: Snapshot, parts: dict[str, str], marks: dict[str, int]) -> bool:
    """Make (parts, marks) the snapshot after ``after``; False if another one is there already."""
    rows = [("part", k, v) for k, v in sorted(parts.items())] + [("mark", k, str(v)) for k, v in sorted(marks.items())]
    written = f"{folder}/{MANIFESTS}/_new-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "kind string, name string, value string").coalesce(1).write.parquet(written)
    done = _put_if_absent(spark, written, f"{folder}/{MANIFESTS}/number={after.number + 1:08d}")
    if not done:
        _store(spark, written).delete(_path(spark, written), True)
    return done


def vacuum(spark: SparkSession, folder: str, keep: int = 10, grace: float = DAY) -> list[str]:
    """Remove all but the ``keep`` newest manifests, and the versions that none of those names.

    Versions younger than ``grace`` seconds stay: a writer may be about to commit them. Returns what went.
    """
    known = numbers(spark, folder)
    kept, old = known[-max(1, keep) :], known[: -max(1, keep)]
    named = set().union(*(load(spark, folder, n).versions() for n in kept))
    gone = [f"{MANIFESTS}/number={n:08d}" for n in old]
    before = time.time() - grace
    gone += [x for x, changed in _entries(spark, folder).items() if x.startswith(VERSION) and x not in named and changed <= before]
    for x in gone:
        _store(spark, folder).delete(_path(spark, f"{folder}/{x}"), True)
    return gone
