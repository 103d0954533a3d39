"""Extraction of triples in micro-batches that stop by themselves, over a ledger of what was read and paid.

``extract`` takes the sections that no ledger entry has, in batches of a few sections a model call, and works
through them in micro-batches of PER_WAVE calls. Before a micro-batch asks, it notes in the ledger what it may
cost; after it, one commit adds its triples, the sections that were read and the tokens spent. So the ledger
is right whenever the run ends: a section is never read twice, and a run of the same name goes on with
what is left of its budget. A run ends before a micro-batch that finds the budget spent, when ``stop()`` says so, or
after a micro-batch with a failed call. A call that raises, or whose reply has no list, is a row with its error: its
sections stay pending and the others of its micro-batch count.

If the driver is lost while a micro-batch asks, the next run takes over its replies if all were written, and otherwise
counts the noted cost as spent, so that the budget is passed by one micro-batch at most. A call that Spark repeats
because its executor was lost is paid twice and counted once.

The calls of a micro-batch are spread over tasks; sections are shuffled once, into a queue that is kept sorted.
Sections are dealt to GROUPS by their path, so that batches are formed in as many tasks, each in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import chunking, knowledge, notes, sessions
from skein.sources import versions

BATCH_CHARS = 6000
PER_WAVE = 64
GROUPS = 32
LEDGER = "key string, run string, wave long, triples long"
TRIPLES = "ord long, source string, relation string, target string, evidence string, confidence double, key string"
PROGRESS = "run string, wave long, done long, failed long, tokens long, triples long, stopped string"
ASKED = "ord long, batch_ids array<string>, reply string, tokens long, error string"
Model = Callable[[str], tuple[str, int]]


def _read(spark: SparkSession, folder: str, what: str, schema: str, number: int | None = None) -> DataFrame:
    held = versions.load(spark, folder, number)
    paths = [f"{folder}/{x}/{what}" for name, x in sorted(held.parts.items()) if name.startswith("wave ")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(key, run, wave, triples) of every section that was read."""
    return _read(spark, folder, "ledger", LEDGER)


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, source, relation, target, evidence, confidence, key) of all runs."""
    return _read(spark, folder, "triples", TRIPLES)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(run, wave, done, failed, tokens, triples, stopped): totals of each run after each of its micro-batches."""
    return _read(spark, folder, "progress", PROGRESS)


def queue(sections: DataFrame, done: DataFrame, instructions: str, limit: int = BATCH_CHARS, groups: int = GROUPS) -> DataFrame:
    """(batch, batch_ids, prompt, cost) of the sections (path, ord, heading, text, key) that are not ``done`` (key)."""
    todo = notes.pending(sections, done)
    whole = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text"))
    slim = todo.select("path", "ord", "key", F.length(whole).alias("size"), F.pmod(F.xxhash64("path"), F.lit(groups)).alias("part"))
    formed = chunking.greedy_batches(slim, "size", limit, ["path", "ord"], ["part"]).select("key", "part", F.col("batch").alias("nth"))
    order = chunking.numbered(formed.select("part", "nth").distinct(), ["part", "nth"]).withColumnRenamed("id", "batch")
    named = todo.join(formed.join(order, ["part", "nth"]).select("key", "batch"), "key")
    return sessions.prompts(named, "batch", instructions).withColumn("cost", F.ceil(F.length("prompt") / 4))


def _ask(rows: DataFrame, model: Model) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, ids, prompt in zip(frame["batch"], frame["batch_ids"], frame["prompt"], strict=True):
                reply, tokens, error = None, 0, None
                try:
                    reply, tokens = model(prompt)
                except Exception as e:  # noqa: BLE001  whatever a provider's client raises is this row's error
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"ord": [n], "batch_ids": [list(ids)], "reply": [reply], "tokens": [tokens], "error": [error]})

    asked = rows.select("batch", "batch_ids", "prompt").mapInPandas(run, ASKED)
    unread = F.col("error").isNull() & F.from_json(tx.json_paths(F.col("reply")), "array<string>").isNull()
    return asked.withColumn("error", F.when(unread, F.lit("the reply has no list of triples")).otherwise(F.col("error")))


class Ledger:
    """The state of one run in a folder; every change of it is one commit."""

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.spark, self.folder, self.run = spark, folder, run
        self.now = versions.load(spark, folder)

    def mark(self, what: str) -> int:
        return self.now.marks.get(f"{what} {self.run}", 0)

    def _commit(self, parts: dict[str, str], marks: dict[str, int]) -> None:
        mine = {f"{k} {self.run}": v for k, v in marks.items()}
        if not versions.commit(self.spark, self.folder, self.now, parts, self.now.marks | mine):
            raise RuntimeError(f"{self.folder} has another writer")
        self.now = versions.load(self.spark, self.folder)

    def begin(self, cost: int) -> str:
        """A folder for the replies of the next micro-batch, whose cost is noted first."""
        version = versions.new_version()
        self._commit(self.now.parts | {f"asking {self.run}": version}, {"noted": cost})
        return version

    def settle(self) -> str | None:
        """Book the micro-batch that was begun; why the run ends after it, or null."""
        version = self.now.parts.get(f"asking {self.run}")
        if version is None:
            return None
        at = f"{self.folder}/{version}"
        rest = {k: v for k, v in self.now.parts.items() if k != f"asking {self.run}"}
        if not versions.complete(self.spark, f"{at}/asked"):
            self._commit(rest, {"tokens": self.mark("tokens") + self.mark("noted"), "noted": 0})
            return None
        asked = self.spark.read.schema(ASKED).parquet(f"{at}/asked")
        found, _ = knowledge.parse_triples(asked.where("error is null"))
        found.select(*(F.col("source_chunk_id").alias("key") if c.split()[0] == "key" else c.split()[0] for c in TRIPLES.split(", "))).write.mode("overwrite").parquet(f"{at}/triples")
        wave = self.mark("waves") + 1
        made = self.spark.read.parquet(f"{at}/triples").groupBy("key").agg(F.count("*").alias("triples"))
        keys = asked.where("error is null").select(F.explode("batch_ids").alias("key")).join(made, "key", "left")
        keys.select("key", F.lit(self.run).alias("run"), F.lit(wave).cast("long").alias("wave"), F.coalesce("triples", F.lit(0)).cast("long").alias("triples")).write.mode("overwrite").parquet(f"{at}/ledger")
        size, bad = F.size("batch_ids"), F.col("error").isNotNull()
        sums = asked.agg(F.sum(F.when(~bad, size).otherwise(0)).alias("done"), F.sum(F.when(bad, size).otherwise(0)).alias("failed"), F.sum("tokens").alias("tokens"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("ord"))).alias("error")).first()
        n_triples = made.agg(F.coalesce(F.sum("triples"), F.lit(0))).first()[0]
        marks = {k: self.mark(k) + int(v or 0) for k, v in (("done", sums["done"]), ("failed", sums["failed"]), ("tokens", sums["tokens"]), ("triples", n_triples))}
        why = f"{sums['error']}; other sections wait" if sums["error"] else None
        row = (self.run, wave, marks["done"], marks["failed"], marks["tokens"], marks["triples"], why)
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{at}/progress")
        self._commit(rest | {f"wave {version}": version}, marks | {"waves": wave, "noted": 0})
        return why


def extract(sections: DataFrame, folder: str, model: Model, budget: int | None = None, run: str = "run", instructions: str = "", per_wave: int = PER_WAVE, limit: int = BATCH_CHARS, stop: Callable[[], bool] = lambda: False) -> str | None:
    """Read pending sections (path, ord, heading, text, key) into triples until none is left or the run has to end; returns why.

    ``model`` takes a prompt and gives (reply, tokens). Of a micro-batch only the calls are made
    before which the estimated cost of the others fits what is left of the budget.
    """
    spark = sections.sparkSession
    book = Ledger(spark, folder, run)
    book.settle()
    at = f"{folder}/{versions.new_version()}/queue"
    queue(sections, ledger(spark, folder), instructions, limit).sort("batch").write.parquet(at)
    waiting = spark.read.parquet(at)
    first, end = 0, waiting.count()
    while first < end:
        rest = None if budget is None else budget - book.mark("tokens")
        if stop():
            return "stopped on request"
        if rest is not None and rest <= 0:
            return f"all {budget:,} tokens of the run are spent"
        rows = waiting.where((F.col("batch") >= first) & (F.col("batch") < first + per_wave))
        # At most ``per_wave`` rows, so their running sum in one task is of a fixed size.
        earlier = F.coalesce(F.sum("cost").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_earlier", earlier)
        rows = rows if rest is None else rows.where(F.col("_earlier") < rest)
        sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost")).first()
        version = book.begin(int(sums["cost"]))
        _ask(rows.repartition(min(sums["n"], spark.sparkContext.defaultParallelism)), model).write.parquet(f"{folder}/{version}/asked")
        if why := book.settle():
            return why
        first += sums["n"]
    return None
