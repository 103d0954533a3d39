"""The first provider with results: ranked sources are asked in waves, each only for what is still open.

A provider is a function of requests (key and their columns) that returns a row per key: (key, answer, reason). An
answer without a reason counts, unless it is null, an empty string or an empty array. A row with both is kept for the case that no
later provider does better. ``calling`` makes a provider of a Python function, whose exceptions are reasons.

What a provider gives is written to the checkpoint folder before the next wave is formed, so that no provider is
asked twice for a key, and what was answered takes no part in later waves. Of requests with one key one is
asked; a null key is a key like others. A key that a provider gives no row for has the reason ``no results``; of
several rows of a provider for one key the least good answer and the least reason count.

A wave shuffles the open requests once, in the columns that its provider reads. Waves are decided on keys and
reasons alone; answers are shuffled once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.plans.lineage import cut

Provider = Callable[[DataFrame], DataFrame]
NOTHING = "no results"


def calling(ask: Callable[..., object], columns: Sequence[str], answer: str = "string") -> Provider:
    """A provider that calls ``ask`` with a request's columns; its result has the type ``answer``.

    ``ask`` may return a pair (answer, reason) in place of an answer, for a result that is only better than none.
    """

    def rows(requests: DataFrame) -> DataFrame:
        asked = requests.select("key", *(c for c in columns if c != "key"))
        schema = T.StructType([requests.schema["key"], T.StructField("answer", _type(requests, answer)), T.StructField("reason", T.StringType())])
        kinds = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        found = ask(*(row[c] for c in columns))
                        value, reason = found if isinstance(found, tuple) else (found, None)
                    except Exception as e:  # noqa: BLE001  whatever a provider's client raises is this row's reason
                        value, reason = None, f"{type(e).__name__}: {e}"
                    out.append({"key": row["key"], "answer": value, "reason": reason})
                yield pa.RecordBatch.from_pylist(out, kinds)

        return asked.mapInArrow(run, schema)

    return rows


def _type(df: DataFrame, ddl: str) -> T.DataType:
    return df.sparkSession.range(0).select(F.lit(None).cast(ddl)).schema[0].dataType


def _given(answer: Column, kind: T.DataType) -> Column:
    """Whether there is an answer at all."""
    if isinstance(kind, T.StringType):
        return answer.isNotNull() & (answer != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return answer.isNotNull() & (F.size(answer) > 0)
    return answer.isNotNull()


def first_answer(requests: DataFrame, providers: Sequence[tuple[str, Provider]]) -> DataFrame:
    """(key, provider, answer, reasons): of each key the first good answer, and why earlier providers gave none.

    Without a good answer it is the first one that came with a reason; without any, provider and answer are
    null, and ``reasons`` has an entry ``name: reason`` for each provider.
    """
    if not providers:
        raise ValueError("at least one provider")
    keyed = requests.withColumn("_key", F.struct("key"))
    waiting = keyed.dropDuplicates(["_key"])
    state = waiting.select("_key", F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("kept_by"))
    chosen: list[DataFrame] = []
    answers: list[DataFrame] = []
    for name, ask in providers:
        rows = ask(waiting.drop("_key"))
        given = F.coalesce(_given(F.col("answer"), rows.schema["answer"].dataType), F.lit(False))
        found = cut(rows.select(F.struct("key").alias("_key"), (~(given & F.col("reason").isNull())).alias("late"), (~given).alias("none"), "answer", "reason"))
        answers.append(found.where(~F.col("none")).select("_key", F.lit(name).alias("provider"), "late", "answer"))
        one = found.groupBy("_key").agg(F.min(F.struct("late", "none", "reason")).alias("x"))
        wave = cut(state.join(one, "_key", "left").select("_key", "reasons", "kept_by", F.coalesce("x.late", F.lit(True)).alias("late"), F.coalesce("x.none", F.lit(True)).alias("none"), "x.reason"))
        chosen.append(wave.where(~F.col("late")).select("_key", F.lit(name).alias("provider"), "late", "reasons"))
        why = F.concat(F.lit(f"{name}: "), F.coalesce("reason", F.lit(NOTHING)))
        state = wave.where("late").select("_key", F.concat("reasons", F.array(why)).alias("reasons"), F.coalesce("kept_by", F.when(~F.col("none"), F.lit(name))).alias("kept_by"))
        waiting = keyed.join(state.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    chosen.append(state.select("_key", F.col("kept_by").alias("provider"), F.lit(True).alias("late"), "reasons"))
    decided, held = reduce(DataFrame.unionByName, chosen), reduce(DataFrame.unionByName, answers)
    joined = decided.join(held, ["_key", "provider", "late"], "left")
    out = joined.groupBy("_key", "provider", "late").agg(F.min("answer").alias("answer"), F.first("reasons").alias("reasons"))
    return out.select("_key.key", "provider", "answer", "reasons")
