"""Traces as append-only tables; a session's last version is its current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx

TEXT_CAP = 4000


def append_steps(steps: DataFrame, path: str) -> None:
    """Append steps; long texts keep their head and tail."""
    capped = {c: tx.truncate(F.col(c), TEXT_CAP) for c in ("args_json", "model_output", "observation") if c in steps.columns}
    steps.withColumns(capped).write.mode("append").parquet(path)


def append_sessions(sessions: DataFrame, path: str) -> None:
    """Append versions of sessions (id, version, ...): a start is version 0, a finish a later one."""
    capped = {c: tx.truncate(F.col(c), TEXT_CAP) for c in ("task", "answer") if c in sessions.columns}
    sessions.withColumns(capped).write.mode("append").parquet(path)


def current(versions: DataFrame) -> DataFrame:
    """One row per session: of each column the latest value that is not null."""
    columns = [c for c in versions.columns if c not in ("id", "version")]
    return versions.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in columns))
