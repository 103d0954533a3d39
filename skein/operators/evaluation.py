"""How good and how fast retrieval is: hits against gold, latency, reading accuracy, costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators.chunking import numbered


def score(hits: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, hit5, rr10, gold_found5) of ``hits`` (qid, rank, *keys) against ``gold`` (qid, *keys)."""
    wanted = gold.select("qid", *keys).distinct()
    found = hits.where("rank <= 10").join(wanted, ["qid", *keys]).groupBy("qid").agg(
        F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= 5, F.struct(*keys))).alias("found5")
    )
    size = wanted.groupBy("qid").agg(F.count("*").alias("gold"))
    rows = size.join(found, "qid", "left")
    return rows.select(
        "qid",
        F.coalesce((F.col("first") <= 5).cast("int"), F.lit(0)).alias("hit5"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr10"),
        (F.coalesce("found5", F.lit(0)) / F.col("gold")).alias("gold_found5"),
    )


def summary(scores: DataFrame, by: str) -> DataFrame:
    """Means per group, and over all groups (null)."""
    return scores.rollup(by).agg(
        F.count("*").alias("n"), F.round(F.avg("hit5"), 6).alias("hit5"), F.round(F.avg("rr10"), 6).alias("mrr10"), F.round(F.avg("gold_found5"), 6).alias("gold_found5")
    )


def latency(calls: DataFrame, by: str, value: str) -> DataFrame:
    """Calls, mean, upper median, 95th percentile by index, and the half width of the mean's 95 % interval.

    Rows are numbered over all groups in ranges, so a large group is not gathered; a group's positions
    count from its first row.
    """
    rows = numbered(calls.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).alias("x")), [by, "x"])
    groups = rows.groupBy(by).agg(F.min("id").alias("_first"), F.count("*").alias("calls"), F.round(F.avg("x"), 6).alias("mean"), F.round(1.96 * F.stddev_samp("x") / F.sqrt(F.count("*")), 6).alias("ci95"))
    at = {"median": F.floor(F.col("calls") / 2), "p95": F.floor(0.95 * (F.col("calls") - 1))}
    wanted = groups.select(by, *((F.col("_first") + place).alias(name) for name, place in at.items()))
    found = rows.join(wanted, by).where((F.col("id") == F.col("median")) | (F.col("id") == F.col("p95")))
    values = found.groupBy(by).agg(*(F.max(F.when(F.col("id") == F.col(name), F.col("x"))).alias(name) for name in at))
    return groups.join(values, by).select(by, "calls", "mean", "median", "p95", "ci95")


def diagnostics(top_scores: DataFrame, thresholds: tuple[float, ...] = (0.72, 0.75)) -> DataFrame:
    """One row: least, upper median and greatest of ``score``, and how many are below each threshold."""
    scores = top_scores.where("score is not null").select("score")
    below = [F.count_if(F.col("score") < t).alias(f"below_{round(t * 100)}") for t in thresholds]
    whole = scores.agg(F.count("*").alias("_n"), F.min("score").alias("least"), F.max("score").alias("greatest"), *below)
    middle = numbered(scores, ["score"]).join(whole.select("_n"), F.col("id") == F.floor(F.col("_n") / 2)).select(F.col("score").alias("median"))
    return whole.crossJoin(middle).select("least", "median", "greatest", *(f"below_{round(t * 100)}" for t in thresholds))


def character_error_rate(truth: Column, read: Column) -> Column:
    return F.levenshtein(truth, read) / F.greatest(F.length(truth), F.lit(1))


def recall(pairs: DataFrame, key: str, truth: Column, read: Column) -> DataFrame:
    """(key, recall): the share of the true items, counted with repeats, that were read."""
    both = pairs.select(F.col(key).alias("key"), truth.alias("t"), read.alias("r"))
    want = both.select("key", F.explode("t").alias("item")).groupBy("key", "item").agg(F.count("*").alias("want"))
    got = both.select("key", F.explode("r").alias("item")).groupBy("key", "item").agg(F.count("*").alias("got"))
    shared = want.join(got, ["key", "item"], "left").groupBy("key").agg(F.sum(F.least("want", F.coalesce("got", F.lit(0)))).alias("shared"), F.sum("want").alias("want"))
    return both.select("key").distinct().join(shared, "key", "left").select("key", (F.coalesce("shared", F.lit(0)) / F.greatest(F.coalesce("want", F.lit(0)), F.lit(1))).alias("recall"))


def reading_accuracy(pairs: DataFrame, key: str, truth: str, read: str) -> DataFrame:
    """(key, cer, word_recall, number_recall) of texts that were read against the true ones."""
    words = recall(pairs, key, tx.tokens(F.col(truth)), tx.tokens(F.col(read))).withColumnRenamed("recall", "word_recall")
    numbers = recall(pairs, key, tx.numbers(F.col(truth)), tx.numbers(F.col(read))).withColumnRenamed("recall", "number_recall")
    cer = pairs.select(F.col(key).alias("key"), character_error_rate(F.col(truth), F.col(read)).alias("cer"))
    return cer.join(words, "key").join(numbers, "key").select("key", *(F.round(c, 6).alias(c) for c in ("cer", "word_recall", "number_recall")))


def reading_summary(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("pages"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("word_recall"), 6).alias("word_recall"), F.round(F.min("word_recall"), 6).alias("least_word_recall"),
        F.round(F.avg("number_recall"), 6).alias("number_recall"),
    )


def cost(stages: DataFrame, parts: dict[str, list[str]], megabytes: float, scales: dict[str, float]) -> DataFrame:
    """(type, seconds, seconds_per_mb, scale, projected_hours) of retrieval types.

    ``stages`` is (stage, seconds); ``parts`` names the stages that each type needs.
    """
    session = stages.sparkSession
    needs = session.createDataFrame([(t, s) for t, names in parts.items() for s in names], "type string, stage string")
    sizes = session.createDataFrame([(n, float(mb)) for n, mb in scales.items()], "scale string, scale_mb double")
    total = needs.join(stages, "stage").groupBy("type").agg(F.sum("seconds").alias("seconds"))
    per = F.col("seconds") / megabytes
    return total.crossJoin(sizes).select("type", F.round("seconds", 6).alias("seconds"), F.round(per, 6).alias("seconds_per_mb"), "scale", F.round(per * F.col("scale_mb") / 3600, 6).alias("projected_hours"))


def small_document(gold: Column, small: list[str]) -> Column:
    """Whether all gold pages, an array of structs with ``file``, are of one document, and that a small one."""
    files = F.array_distinct(F.transform(gold, lambda g: g["file"]))
    return F.coalesce((F.size(files) == 1) & F.get(files, F.lit(0)).isin(small), F.lit(False))


def pick(questions: DataFrame, per_category: int = 3) -> DataFrame:
    """Questions (id, category, small) for an answer test, in order of id.

    All without an answer, all about small documents, and others while their category has fewer than
    ``per_category`` picked ones. Once a category is full no other is picked, so the picked ones
    before a question number fewer than the limit just if all ones before it do.
    """
    before = Window.partitionBy("category").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = questions.withColumn("_small", F.coalesce(F.sum(F.col("small").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("_other", F.coalesce(F.sum((~F.col("small")).cast("int")).over(before), F.lit(0)))
    taken = (F.col("category") == "none") | F.col("small") | (F.col("_small") + F.col("_other") < per_category)
    return rows.where(taken).select(*questions.columns)


def answer_summary(rows: DataFrame) -> DataFrame:
    """(mode, answerable, n, correct, partial, tokens): shares of grades, and mean tokens."""
    share = lambda grade: F.round(F.avg((F.col("grade") == grade).cast("int")), 6)
    return rows.groupBy("mode", "answerable").agg(F.count("*").alias("n"), share("correct").alias("correct"), share("partial").alias("partial"), F.round(F.avg("tokens"), 6).alias("tokens"))


def half_width(deviation: float, n: int) -> float:
    """Half of a mean's 95 % interval."""
    return 1.96 * deviation / math.sqrt(n)
