"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, and a proof per row.

A node is the lower-case hexadecimal SHA-256 of its children's digests as text; every 3 consecutive nodes of
a level (the last run may be shorter, even one) become one of the next. What remains of a group is its
subroot (of a single leaf, the leaf); the subroots, ordered by group, make the root in the same way. A proof
is a list of steps, one a level, each with the digests left and right of the node in its run; folding a leaf
through them gives the root.

Plan: leaves are digests made by built-in functions, so that texts are read once and never shuffled. Slim
rows are dealt by range of (group, order), and each partition is sorted; a row's own number is the last key,
so that a hot group, or equal rows, are split like any others. The driver gets one row a partition (rows of its first
and last group), from which follow each partition's offset in its first group and the sizes of
the two groups that it may share with others. A partition then builds all subtrees whose leaves it
holds. The nodes at its ragged edges, whose parents it cannot build, a few a level, are shuffled by the
coordinate of an ancestor LEVELS_UP levels or more above, and become that ancestor, round by round, until only
subroots are left. The upper steps found on the way go back down by joins of these few nodes, and
a row's lower steps, made by its partition, are joined with its top node's upper ones (broadcast if they are
counted to be few). The subroots are the leaves of a tree of one group, so any number of groups will do.

Sorted leaves and edge nodes are written to the checkpoint folder: a partition that is lost and built again
reads the same rows. A partition holds about PARTITION_ROWS slim rows in memory.

Defined results: null and empty values differ (``-`` and ``0:``), nulls sort first in groups and in
order; rows with equal keys are ordered by leaf, and equal leaves are exchangeable. Every row has its own
place and proof. An empty table gives no rows. ``carry`` names further columns to return.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut
from skein.llm.text_arrays import give_back

FAN = 3
PARTITION_ROWS = 100_000
LEVELS_UP = 5
#: Top nodes whose proofs are broadcast (about 2 kB each); beyond, they are joined.
BROADCAST_TOPS = 20_000
#: Rows whose proofs are handed over at once.
ROWS = 4096
STEPS = "array<struct<left: string, right: string>>"
NODE = "grp string, size long, level int, at long, digest string"


def serialised(column: Column) -> Column:
    """A value as ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(serialised, columns)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _sha(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _parent(level: int, size: int) -> int:
    """Nodes of a level of a tree with ``size`` leaves."""
    return -(-size // FAN**level)


class Levels:
    """The nodes that can be built from a run of consecutive leaves, ``first`` and on, of a group of ``size``."""

    def __init__(self, digests: list[str], first: int, size: int) -> None:
        self.size = size
        self.nodes, self.low = [digests], [first]
        while (here := _parent(level := len(self.nodes) - 1, size)) > 1:
            low, high = self.low[level], self.low[level] + len(self.nodes[level])
            begin, end = -(-low // FAN), _parent(1, here) if high == here else high // FAN
            if begin >= end:
                break
            own = self.nodes[level]
            self.nodes.append([_sha(own[FAN * j - low : FAN * j + FAN - low]) for j in range(begin, end)])
            self.low.append(begin)

    def has(self, level: int, at: int) -> bool:
        return level < len(self.nodes) and 0 <= at - self.low[level] < len(self.nodes[level])

    def tops(self) -> Iterator[tuple[int, int, str]]:
        """Level, place and digest of the nodes whose parent is not here."""
        for level, own in enumerate(self.nodes):
            begin, end = self.low[level], self.low[level] + len(own)
            if level + 1 < len(self.nodes):
                inner, outer = self.low[level + 1] * FAN, (self.low[level + 1] + len(self.nodes[level + 1])) * FAN
                edge = [*range(begin, min(inner, end)), *range(max(min(outer, end), begin), end)]
            else:
                edge = range(begin, end)
            for at in edge:
                yield level, at, own[at - begin]

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
        """Of each leaf: level and place of its top node, the number of steps up to it; and a pool of all nodes' steps."""
        left, right, base = [], [], []
        for level, own in enumerate(self.nodes[:-1]):
            base.append(len(left))
            low = self.low[level]
            for k in range(len(own)):
                at = low + k
                run = at - at % FAN - low
                left.append("".join(own[max(run, 0) : k]))
                right.append("".join(own[k + 1 : max(run + FAN, 0)]))
        pool = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        count = len(self.nodes[0])
        at, height = self.low[0] + np.arange(count), np.zeros(count, np.int64)
        for level in range(1, len(self.nodes)):
            above = at // FAN
            up = (height == level - 1) & (above >= self.low[level]) & (above < self.low[level] + len(self.nodes[level]))
            at, height = np.where(up, above, at), height + up
        return height, at, np.array([*base, 0], np.int64), pool


def _segments(batches: Iterator[pa.RecordBatch], offsets: dict[int, tuple[int, int, int]]) -> Iterator[tuple[pa.Table, str, Levels]]:
    """The rows of each group in a sorted partition, with what can be built from them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    groups = rows.column("grp").to_pylist()
    first, total_first, total_last = offsets[rows.column("part")[0].as_py()]
    begins = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1])]
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(groups)], strict=True)):
        size = total_first if k == 0 else total_last if b == len(groups) else b - a
        yield rows.slice(a, b - a), groups[a], Levels(rows.column("digest").slice(a, b - a).to_pylist(), first if k == 0 else 0, size)


def _offsets(ordered: DataFrame) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Of each partition: where it begins in its first group, that group's size and its last one's; and the largest group's size."""
    counts = ordered.groupBy("part", "grp").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min("grp").alias("g0"), F.min_by("n", "grp").alias("n0"), F.max("grp").alias("g1"), F.max_by("n", "grp").alias("n1"), F.max("n").alias("most"))
    rows = sorted(ends.collect(), key=lambda r: r["part"])
    total: dict[str, int] = {}
    begin = {}
    for r in rows:
        begin[r["part"]] = total.get(r["g0"], 0)
        for g, n in {r["g0"]: r["n0"], r["g1"]: r["n1"]}.items():
            total[g] = total.get(g, 0) + n
    largest = max([0, *total.values(), *(r["most"] for r in rows)])
    return {r["part"]: (begin[r["part"]], total[r["g0"]], total[r["g1"]]) for r in rows}, largest


def _climb(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes``, which lie at ``level`` or below and cover their ancestors there, with steps up to these: coordinates of both."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["level"])
        size, top = rows[0]["size"], min(level, rows[0]["root_level"])
        known = {(r["level"], r["at"]): r["digest"] for r in rows}
        lowest = rows[0]["level"]
        here = {at for lv, at in known if lv == lowest}
        for lv in range(lowest, top):
            wide = _parent(lv, size)
            here |= {at for x, at in known if x == lv}
            above = {at // FAN for at in here}
            for j in above:
                known[lv + 1, j] = _sha([known[lv, c] for c in range(FAN * j, min(FAN * j + FAN, wide))])
            here = above
        out = []
        for r in rows:
            steps, at = [], r["at"]
            for lv in range(r["level"], top):
                run_, wide = at - at % FAN, _parent(lv, size)
                steps.append({"left": "".join(known[lv, c] for c in range(run_, at)), "right": "".join(known[lv, c] for c in range(at + 1, min(run_ + FAN, wide)))})
                at //= FAN
            out.append({"grp": r["grp"], "size": size, "level": r["level"], "at": r["at"], "steps": steps, "up_level": top, "up_at": at, "up_digest": known[top, at]})
        return pa.Table.from_pylist(out, schema=shape)

    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    shape = pa.schema([("grp", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("steps", step), ("up_level", pa.int32()), ("up_at", pa.int64()), ("up_digest", pa.string())])
    # The level of a group's root: how often its size is divided, rounding up, until one is left.
    root_level = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(float(FAN)), k)), lambda p: p < F.col("size")))
    ancestor = F.floor(F.col("at") / F.pow(F.lit(float(FAN)), F.lit(level) - F.col("level"))).cast("long")
    keyed = nodes.withColumn("root_level", root_level.cast("int")).withColumn("ancestor", ancestor)
    return keyed.groupBy("grp", "ancestor").applyInArrow(run, f"grp string, size long, level int, at long, steps {STEPS}, up_level int, up_at long, up_digest string")


def tree(leaves: DataFrame, partition_rows: int = PARTITION_ROWS, levels_up: int = LEVELS_UP) -> tuple[DataFrame, DataFrame]:
    """For rows of grp (text), digest and columns named in ``key*`` to order by: the rows with ``proof`` up to
    their group's subroot and the ``subroot``, and a table of grp and subroot."""
    order = [c for c in leaves.columns if c.startswith("key")]
    numbered = cut(leaves.withColumn("own", F.monotonically_increasing_id()))
    spark = leaves.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // partition_rows))
    dealt = numbered.repartitionByRange(n_parts, "grp", *order, "digest", "own").sortWithinPartitions("grp", *order, "digest", "own")
    ordered = cut(dealt.drop("own")).withColumn("part", F.spark_partition_id())
    offsets, largest = _offsets(ordered)
    shared = spark.sparkContext.broadcast(offsets)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grp, own in _segments(batches, shared.value):
            rows = list(own.tops())
            level, at, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(rows)), pa.array([own.size] * len(rows), pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(digest)], names=["grp", "size", "level", "at", "digest"])

    tops = cut(ordered.select("part", "grp", "digest").mapInArrow(edges, NODE))
    upper = _finish(tops, largest, max(1, numbered.count() // n_parts), levels_up)
    carried = [c for c in ordered.columns if c not in ("part", "grp", "digest")]
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, own in _segments(batches, shared.value):
            height, at, base, pool = own.steps()
            place = own.low[0] + np.arange(rows.num_rows)
            for a in range(0, rows.num_rows, ROWS):
                some, tall, where = rows.slice(a, ROWS), height[a : a + ROWS], place[a : a + ROWS]
                ends = np.concatenate([[0], np.cumsum(tall)])
                lv = np.arange(ends[-1]) - np.repeat(ends[:-1], tall)
                node = np.repeat(where, tall) // FAN**lv - np.array(own.low, np.int64)[lv] + base[lv]
                proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pool.take(pa.array(node)))
                columns = [some.column(c).combine_chunks() for c in ("grp", "digest", *carried)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tall, pa.int32()), pa.array(at[a : a + ROWS]), proof], names=["grp", "digest", *carried, "level", "at", "lower"])
        give_back()

    made = ordered.select("part", "grp", "digest", *(f"`{c}`" for c in carried)).mapInArrow(lower, ", ".join(["grp string", "digest string", *(f"`{c}` {kinds[c]}" for c in carried), "level int", "at long", f"lower {STEPS}"]))
    few = upper.count() <= BROADCAST_TOPS
    rows = made.join(F.broadcast(upper) if few else upper, ["grp", "level", "at"])
    subroots = upper.groupBy("grp").agg(F.first("subroot").alias("subroot"))
    return rows.select("grp", "digest", *(f"`{c}`" for c in carried), F.concat("lower", "steps").alias("proof"), "subroot"), subroots


def _finish(tops: DataFrame, largest: int, partition: int, levels_up: int) -> DataFrame:
    """grp, level, at, the steps from there to the subroot, and the subroot, of every top node."""
    last = 0
    while FAN**last < largest:
        last += 1
    level = 0
    while FAN**level < partition:
        level += 1
    level = min(last, level + levels_up)
    # Partitions hold ``partition`` rows on average, so an ancestor at this level has the edges of few partitions below it.
    rounds: list[DataFrame] = []
    waiting = tops
    while True:
        done = cut(_climb(waiting.where(F.col("level") <= level), level))
        rounds.append(done)
        if level >= last:
            break
        up = done.groupBy("grp", F.col("up_level").alias("level"), F.col("up_at").alias("at")).agg(F.first("size").alias("size"), F.first("up_digest").alias("digest"))
        waiting = up.select("grp", "size", "level", "at", "digest").unionByName(waiting.where(F.col("level") > level))
        level = min(last, level + levels_up)
    found = rounds.pop()
    found = found.select("grp", "level", "at", "steps", F.col("up_digest").alias("subroot"))
    while rounds:
        below = rounds.pop()
        above = found.select("grp", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("steps").alias("rest"), "subroot")
        joined = below.join(above, ["grp", "up_level", "up_at"]).select("grp", "level", "at", F.concat("steps", "rest").alias("steps"), "subroot")
        # What waited for a later round is in ``found`` already; ancestors of this round's nodes are not tops.
        found = joined.unionByName(found.join(below.select("grp", F.col("up_level").alias("level"), F.col("up_at").alias("at")).distinct(), ["grp", "level", "at"], "left_anti"))
    return cut(found)


def manifest(df: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None, partition_rows: int = PARTITION_ROWS, levels_up: int = LEVELS_UP) -> DataFrame:
    """``order``, ``carry``, leaf, subroot, root and proof of every row; ``columns`` make the leaf."""
    col = lambda c: F.col(f"`{c}`")
    # A prefix tells a null group from the others and puts it first.
    grp = F.coalesce(F.concat(F.lit("s"), col(group).cast("string")), F.lit("n"))
    more = {f"c{i}": v for i, v in enumerate((carry or {}).values())}
    leaves = df.select(grp.alias("grp"), leaf(*map(col, columns)).alias("digest"), col(order).alias("key"), *(v.alias(k) for k, v in more.items()))
    rows, subroots = tree(leaves, partition_rows, levels_up)
    top, _ = tree(subroots.select(F.lit("").alias("grp"), F.col("subroot").alias("digest"), F.col("grp").alias("key")), partition_rows, levels_up)
    upper = cut(top.select(F.col("key").alias("grp"), F.col("proof").alias("above"), F.col("subroot").alias("root")))
    few = upper.count() <= BROADCAST_TOPS
    joined = rows.join(F.broadcast(upper) if few else upper, "grp")
    return joined.select(F.col("key").alias(order), *(F.col(k).alias(name) for k, name in zip(more, carry or {}, strict=True)), F.col("digest").alias("leaf"), "subroot", "root", F.concat("proof", "above").alias("proof"))


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and whether each stands its proof once some have lost their line breaks."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = leaf(*(changed if c == "text" else F.col(c) for c in LEAF))
    rows = manifest(docs, LEAF, "source", "doc_id", {"seen": seen})
    folded = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("seen"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, leaves: str, levels: int) -> str:
    """Levels of a tree over ``leaves`` (grp, i, h), their siblings, and each leaf's proof: ``{name}_path`` with grp, i, root, and lists."""
    out = [f"{name}0 AS MATERIALIZED (SELECT grp, i, h, count(*) OVER (PARTITION BY grp) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, i // {FAN} AS j, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT grp, j AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, CASE WHEN n = 1 THEN 1 ELSE (n + {FAN - 1}) // {FAN} END AS n FROM {name}r{k})")
    sides = [f"CASE WHEN r{k}.n = 1 THEN NULL ELSE [array_to_string(r{k}.hs[1:(l.i // {FAN**k}) % {FAN}], ''), array_to_string(r{k}.hs[(l.i // {FAN**k}) % {FAN} + 2:], '')] END" for k in range(levels)]
    joins = " ".join(f"JOIN {name}r{k} r{k} ON l.grp = r{k}.grp AND l.i // {FAN ** (k + 1)} = r{k}.j" for k in range(levels))
    out.append(f"{name}_path AS MATERIALIZED (SELECT l.grp, l.i, top.h AS root, list_filter([{', '.join(sides)}], lambda s: s IS NOT NULL) AS steps FROM {name}0 l {joins} JOIN {name}{levels} top ON l.grp = top.grp)")
    return ",\n".join(out)


def oracle(levels: int = 11, group_levels: int = 5) -> str:
    """The same in SQL, for groups of at most FAN ** levels rows and FAN ** group_levels groups."""
    part = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in LEAF) + ")"
    step = "lambda d, z: xor(d >> 1, (d & 1) * 3988292384)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], {step})))"
    return f"""WITH leaves AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, 'n') AS grp, {digest('text')} AS h,
    CASE WHEN ({crc}) % 2 = 0 THEN {digest("replace(text, chr(10), '')")} ELSE {digest('text')} END AS seen FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_levels_sql("a", "placed", levels)},
groups AS MATERIALIZED (SELECT '' AS grp, grp AS of, h, row_number() OVER (ORDER BY grp) - 1 AS i FROM a{levels}),
{_levels_sql("b", "groups", group_levels)},
whole AS (SELECT p.doc_id, p.h AS leaf, p.seen, a.root AS subroot, b.root, list_concat(a.steps, b.steps) AS steps
  FROM placed p JOIN a_path a ON p.grp = a.grp AND p.i = a.i JOIN groups g ON p.grp = g.of JOIN b_path b ON g.i = b.i),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), '')) AS proof_sha256,
  list_reduce(list_prepend([seen, ''], steps), lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


ORACLE = oracle()
