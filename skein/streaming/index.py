"""Continuous indexing: a stream of changed notes is folded into snapshots of the stored index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skein.operators import chunking, incremental
from skein.sources import versions

THROTTLE = "5 seconds"
#: Notes are dealt into so many buckets by the hash of their path; a batch rewrites only those it touches.
BUCKETS = 256
COLUMNS = ("id", "path", "heading", "ord", "line", "text", "vec")
#: How often a batch begins again because another writer has committed meanwhile.
ATTEMPTS = 5


def _bucket(path: str, buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, parts: dict[str, str], schema: T.StructType) -> DataFrame:
    paths = [f"{folder}/{x}" for _, x in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The index of the newest snapshot, or of an older one: (id, path, heading, ord, line, text, vec)."""
    return _read(spark, folder, versions.load(spark, folder, number).parts, spark.read.parquet(f"{folder}/schema").schema)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What Spark calls the stream that has this checkpoint folder; a new folder is a new stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def apply_batch(batch: DataFrame, number: int, stream: str, folder: str, encode: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> bool:
    """Fold one batch of changes into the index; False if this stream's batch of that number, or a later one, is in already."""
    spark = batch.sparkSession
    newest = Window.partitionBy("path").orderBy(F.desc("version"), F.desc_nulls_last("text"))
    last = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").persist()
    try:
        touched = {str(r[0]) for r in last.select(_bucket("path", buckets)).distinct().collect()}
        sections = chunking.sections(last.where("text is not null")).select("id", "path", "heading", "ord", "line", "text")
        empty = encode(sections.limit(0)).select(*COLUMNS)
        empty.write.mode("ignore").parquet(f"{folder}/schema")
        gone = last.where("text is null").select("path")
        for _ in range(ATTEMPTS):
            base = versions.load(spark, folder)
            if base.marks.get(stream, -1) >= number:
                return False
            before = _read(spark, folder, {b: x for b, x in base.parts.items() if b in touched}, empty.schema)
            state = incremental.upsert(before.join(gone, "path", "left_anti"), sections, encode).select(*COLUMNS)
            version = versions.new_version()
            state.withColumn("bucket", _bucket("path", buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
            filled = {str(r[0]) for r in spark.read.schema("bucket int").parquet(f"{folder}/{version}").select("bucket").distinct().collect()}
            parts = {b: x for b, x in base.parts.items() if b not in touched} | {b: f"{version}/bucket={b}" for b in filled}
            if versions.commit(spark, folder, base, parts, base.marks | {stream: number}):
                return True
        raise RuntimeError(f"{folder}: other writers were first {ATTEMPTS} times")
    finally:
        last.unpersist()


def follow(changes: DataFrame, folder: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], once: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Index ``changes`` (path, version, text; a null text removes a note) into snapshots of ``folder``.

    Each batch writes the buckets that its notes are in as a new version and commits a manifest of which
    version holds each bucket; other buckets are neither read nor written. The last change of a path in a
    batch counts. The manifest records the stream's last batch, so a batch that is run again counts once; a stream with
    a new checkpoint is another stream and goes on from the snapshot that it finds. ``versions.vacuum`` removes what
    no recent snapshot names.
    """

    def fold(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, stream_id(batch.sparkSession, checkpoint), folder, encode, buckets)

    writer = changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=THROTTLE)).start()
