"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

A log that writes a conversation again after each turn holds every prefix of it. Turns are numbered by
their rank in the conversation, wherever the log's own numbers begin and whatever gaps they have. Each
is hashed with its place and role, and the hashes of the turns so far are rolled by exclusive or in 128
bits into a hash of every prefix. A conversation whose whole hash is that of a proper prefix of another
is dropped by an anti-join; of conversations with equal turns the least id stays. Those that are left
are rendered in the ChatML layout.

Nothing gathers an unbounded group: ranks and prefixes are rolled within ranges of 1,024 turn numbers
and the ranges' totals are rolled over the conversation, prefix hashes are made distinct before the
anti-join, and a conversation is rendered in parts of 512 turn numbers, one row each.

Defined results: a null role counts as ``unknown``, a null text as empty. A row without an id is a
conversation of its own. Rows without a turn number come before all others, as one step; they are
rendered apart, dealt by hash over parts below 0. Repeated rows count once; different rows with one turn
number are one step of the prefix. ``<|`` in a text is written as ``< |``, so that no text can open or
close a turn. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

RANGE = 1024
PART = 512


#: The turn number of rows without one.
NO_TURN = -(1 << 62)


def turns(conversations: DataFrame) -> DataFrame:
    """_key, turn, role, text without nulls; ``_key`` holds what tells conversations apart."""
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(NO_TURN)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.md5(F.concat_ws("\u001f", F.col("turn").cast("string"), "role", "text"))).otherwise("")
    # A struct is equal to itself even where the id in it is null; rows without an id come last.
    return rows.select(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", own.alias("own")).alias("_key"), "turn", "role", "text")


def _rolled(steps: DataFrame, before: dict[str, Column], within: dict[str, Column]) -> DataFrame:
    """``steps`` with aggregates over all earlier ranges of the conversation and within the own range."""
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_key", "_range").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.groupBy("_key", "_range").agg(*(v.alias(k) for k, v in before.items()))
    totals = totals.select("_key", "_range", *(F.coalesce(f(k).over(earlier), F.lit(0).cast("long")).alias(k) for k, f in (((k, F.sum if k == "_n" else F.bit_xor) for k in before))))
    return steps.select("*", *(v.over(inner).alias(k) for k, v in within.items())).join(totals, ["_key", "_range"])


def prefixes(rows: DataFrame) -> DataFrame:
    """_key, place, p1, p2: the hash of each prefix, and whether it is the whole (``whole``)."""
    hashed = rows.select("_key", "turn", *(F.xxhash64(F.lit(salt), "role", "text").alias(h) for salt, h in (("first", "h1"), ("second", "h2"))))
    steps = hashed.distinct().groupBy("_key", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    steps = steps.withColumn("_range", F.floor(F.col("turn") / RANGE))
    placed = _rolled(steps, {"_n": F.count("*")}, {"_nth": F.count("*")}).withColumn("place", F.col("_n") + F.col("_nth"))
    # Written once, without texts, as three aggregates read it.
    placed = cut(placed.select("_key", "_range", "turn", "place", *(F.xxhash64(F.lit(salt), "place", "h1", "h2").alias(h) for salt, h in (("first", "h1"), ("second", "h2")))))
    rolled = _rolled(placed, {"_b1": F.bit_xor("h1"), "_b2": F.bit_xor("h2")}, {"_w1": F.bit_xor("h1"), "_w2": F.bit_xor("h2")})
    last = placed.groupBy("_key").agg(F.max("place").alias("_last"))
    return rolled.join(last, "_key").select("_key", "place", F.col("_b1").bitwiseXOR(F.col("_w1")).alias("p1"), F.col("_b2").bitwiseXOR(F.col("_w2")).alias("p2"), (F.col("place") == F.col("_last")).alias("whole"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, _key) of the conversations that are no proper prefix of another, the least of equal ones."""
    found = prefixes(turns(conversations))
    parts = found.where("not whole").select("p1", "p2").distinct()
    whole = found.where("whole").groupBy("p1", "p2").agg(F.min("_key").alias("_key"))
    return whole.join(parts, ["p1", "p2"], "left_anti").select("_key.conv_id", "_key")


def _render(x: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit("<|im_end|>\n"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered of the maximal conversations."""
    rows = turns(conversations).join(maximal(conversations).select("_key"), "_key", "left_semi")
    apart = -1 - F.conv(F.substring(F.md5(F.concat_ws("\u001f", "role", "text")), 1, 5), 16, 10).cast("long")
    part = F.when(F.col("turn") == NO_TURN, apart).otherwise(F.greatest(F.floor(F.col("turn") / PART), F.lit(0)))
    grouped = rows.withColumn("part", part.cast("long")).groupBy("_key", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("_turns"))
    return grouped.select("_key.conv_id", "part", F.size("_turns").cast("long").alias("n_turns"), F.array_join(F.transform("_turns", _render), "").alias("rendered"))


ORACLE = rf"""
WITH r AS (SELECT DISTINCT conv_id, coalesce(turn, {NO_TURN}) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'own ' || md5(turn || chr(31) || role || chr(31) || text) ELSE 'id ' || conv_id END AS k FROM r),
s AS (SELECT k, any_value(conv_id) AS conv_id, turn, string_agg(role || chr(30) || text, chr(28) ORDER BY role, text) AS step FROM t GROUP BY k, turn),
p AS (SELECT k, conv_id, row_number() OVER (PARTITION BY k ORDER BY turn) = count(*) OVER (PARTITION BY k) AS whole,
             md5(string_agg(step, chr(29)) OVER (PARTITION BY k ORDER BY turn)) AS h FROM s),
least_of AS (SELECT h, k FROM p WHERE whole QUALIFY row_number() OVER (PARTITION BY h ORDER BY conv_id IS NULL, conv_id, k) = 1),
kept AS (SELECT k FROM least_of WHERE h NOT IN (SELECT h FROM p WHERE NOT whole))
SELECT any_value(conv_id) AS conv_id, part, count(*)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM (SELECT *, CASE WHEN turn = {NO_TURN} THEN -1 - ('0x' || left(md5(role || chr(31) || text), 5))::BIGINT ELSE greatest(turn // {PART}, 0)::BIGINT END AS part FROM t SEMI JOIN kept USING (k))
GROUP BY k, part
"""
