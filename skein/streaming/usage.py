"""Streams of trace events: usage, windows, and runs of repeated actions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, a file or a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def usage(stream: DataFrame, by: list[str]) -> DataFrame:
    """(by, calls): a running count, for output mode complete or update."""
    return stream.groupBy(*by).agg(F.count("*").alias("calls"))


def windowed(stream: DataFrame, by: str, late: str = "1 hour", size: str = "24 hours", slide: str | None = None) -> DataFrame:
    """(start, by, calls, total): counts and sums per time window; rows later than ``late`` are left out."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), by)
    return grouped.agg(F.count("*").alias("calls"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "calls", "total")


def repeats(stream: DataFrame, session: str = "user_id", action: str = "event_type", order: str = "event_id") -> DataFrame:
    """(session, action, length): the current run of equal actions of each session, after each batch.

    State is the last action and its count, per session.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        for name in pd.concat(list(frames)).sort_values("at")["action"]:
            last, count = name, count + 1 if name == last else 1
        state.update((last, count))
        yield pd.DataFrame({"session": [key[0]], "action": [last], "length": [count]})

    rows = stream.select(F.col(session).alias("session"), F.col(action).alias("action"), F.col(order).alias("at"))
    return rows.groupBy("session").applyInPandasWithState(update, "session long, action string, length long", "action string, length long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, and return its result as the table ``name``.

    For small results: they are kept on the driver.
    """
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
