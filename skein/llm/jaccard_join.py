"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them.

Texts with equal words in equal order are copies; one of them, with the least id, stands for all.
Each such text gets MinHash values of its five-word shingles, cut into bands whose number and width
give the target recall at the threshold. Texts that share a band hash must be compared.

They are compared in blocks. Texts that bands connect form a block; one that would hold too many
texts or shingles is dealt into several by hash. A block is one unit of work, and so are two blocks
that have bands in common; a text goes to a unit of two blocks only if it shares a band with a text
of the other block. All pairs of a unit are verified on whole shingle sets. A unit returns one row
per text, with the number of its links and the least text linked to it in the unit, so no pair is
ever a row, and no link is lost by a limit. Classes are the connected components of the links.

Shuffles: band hashes (16 bytes a band), then texts of candidates only, one copy per unit. Group
sizes are bounded by the block limits; joins have a unique key on one side, so adaptive execution
can split what is hot on the other.

Defined results: words are separated by white space and compared in lower case; texts of one to
four words have one shingle, their whole; texts without words are copies of each other. Rows with
a null id belong to no class and have no links. Repeated rows are copies. Different texts with one id
are different texts, each with its own links; ids can be of any type that has an order. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import text_arrays
from skein.llm.common import cut, pack, unpack

THRESHOLD_PERCENT = 80
TARGET_RECALL = 0.995
MOST_HASHES = 240
BLOCK_SHINGLES = 400_000
BLOCK_TEXTS = 1024
SEED = 7


def banding(threshold: float = THRESHOLD_PERCENT / 100, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the widest bands that reach the recall at the threshold with ``most`` hashes."""
    for rows in range(most, 0, -1):
        match = threshold**rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-match)) if match < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches the recall")


def _band_hashes(shingles: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per text and band; texts have a shingle at least."""
    rng = np.random.default_rng(SEED)
    starts = np.cumsum(counts) - counts
    low_bits = shingles.astype(np.uint32)
    value = np.empty_like(low_bits)
    out = np.zeros((len(counts), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(counts), b + 1, np.uint64)
        for _ in range(rows):
            a, c = rng.integers(0, 2**32, 2, dtype=np.uint32)
            np.multiply(low_bits, a | np.uint32(1), out=value)
            np.add(value, c, out=value)
            total = text_arrays.mix(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, starts))
        out[:, b] = total
    return out


def _whole(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, whole, k1, k2, n, bands): hashes of the text and of its word sequence, number of shingles, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_arrays.slices(batch, "text"):
                words, counts = text_arrays.word_hashes(part.column("text"))
                shingles, n = text_arrays.shingles(words, counts)
                full = n > 0
                place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = []
                for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
                    at_place = text_arrays.mix(words + text_arrays.mix(place.astype(np.uint64) * salt + salt))
                    key = np.zeros(len(counts), np.uint64)
                    if len(words):
                        key[full] = np.add.reduceat(at_place, (np.cumsum(counts) - counts)[full])
                    keys.append(pa.array(key.view(np.int64)))
                hashes = _band_hashes(shingles, n[full], bands, rows) if full.any() else np.zeros((0, bands), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("whole"), *keys, pa.array(n), lists], names=["doc_id", "whole", "k1", "k2", "n", "bands"])
        text_arrays.give_back()

    slim = docs.select(F.col(doc_id).alias("doc_id"), _whole(text).alias("whole"), F.col(text).alias("text")).where("doc_id is not null")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, whole long, k1 long, k2 long, n long, bands array<long>")


def _overlaps(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Numbers of shared shingles of all pairs of n texts; ``sets`` and ``owner`` without repeats."""
    order = np.argsort(sets, kind="stable")
    values, who = sets[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    shared = np.zeros((n, n), np.float32)
    common = np.flatnonzero(sizes >= 64)
    for k in range(0, len(common), 2048):
        part = common[k : k + 2048]
        grid = np.zeros((n, len(part)), np.float32)
        at = np.repeat(starts[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(sizes[part].sum())
        grid[who[at], np.repeat(np.arange(len(part)), sizes[part])] = 1
        shared += grid @ grid.T
    flat = shared.ravel()
    for size in np.unique(sizes[(sizes >= 2) & (sizes < 64)]).tolist():
        for some in np.array_split(starts[sizes == size], 1 + (sizes == size).sum() * size * size // 4_000_000):
            members = who[some[:, None] + np.arange(size)]
            cells = (members[:, :, None] * n + members[:, None, :]).ravel()
            flat += np.bincount(cells, minlength=n * n).astype(np.float32) if len(cells) * 4 > n * n else _sparse_count(cells, n * n)
    return shared


def _sparse_count(cells: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.float32)
    np.add.at(out, cells, 1)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index in each index's connected component."""
    label = np.arange(len(links), dtype=np.int32)
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        low = np.where(linked, label[None, :], np.int32(len(links))).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(rep: np.ndarray, side: np.ndarray, weight: np.ndarray, sets: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a unit: linked texts, linked documents, and the least text of its component."""
    order = np.argsort(rep, kind="stable")
    back = np.argsort(order)
    n = len(rep)
    owner = np.repeat(back, counts)
    shared = _overlaps(sets, owner, n)
    # shared / (a + b - shared) >= p / 100, in whole numbers; these are exact in 32 bits below 2^24
    kind = np.float32 if int(counts.max()) * 2 * (100 + percent) < 1 << 24 else np.float64
    sizes, of = (percent * counts[order]).astype(kind), side[order]
    shared = shared.astype(kind, copy=False)
    shared *= kind(100 + percent)
    links = shared >= sizes[:, None] + sizes[None, :]
    links &= (of[:, None] != of[None, :]) | (of[:, None] == 0)
    np.fill_diagonal(links, False)
    roots = rep[order][_roots(links)]
    return links.sum(axis=1)[back], (links @ weight[order].astype(np.int64))[back], roots[back]


def _units(percent: int):  # noqa: ANN202
    """Verify runs of rows with one unit id; rows arrive sorted by it."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        unit = table.column("unit").to_numpy()
        rep, side, weight = (table.column(c).to_numpy() for c in ("rep", "side", "size"))
        sets, counts = _distinct_sets(table)
        edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        texts, docs, roots = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64), rep.copy()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                texts[a:b], docs[a:b], roots[a:b] = _verify(rep[a:b], side[a:b], weight[a:b], sets[ends[a] : ends[b]], counts[a:b], percent)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, texts, docs, roots)], names=["rep", "n_texts", "n_docs", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in text_arrays.slices(batch, "text"):
                unit = part.column("unit").to_numpy()
                last = int(np.searchsorted(unit != unit[-1], False)) if (unit == unit[-1]).all() else int(np.flatnonzero(unit != unit[-1])[-1]) + 1
                # All units but the last are complete; those that began earlier end here or go on.
                if last > 0 or (held and held[-1].column("unit")[-1].as_py() != int(unit[0])):
                    if last > 0:
                        held.append(part.slice(0, last))
                    yield whole(pa.Table.from_batches(held))
                    held = []
                held.append(part.slice(last))
        if held:
            yield whole(pa.Table.from_batches(held))
        held.clear()
        text_arrays.give_back()

    return run


def _distinct_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, and their number."""
    values, owners, rows = [], [], 0
    for batch in table.to_batches():
        words, counts = text_arrays.word_hashes(batch.column("text"))
        shingles, n = text_arrays.shingles(words, counts)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        keep = np.ones(len(owner), bool)
        keep[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
        values.append(shingles[keep])
        owners.append(owner[keep] + rows)
        rows += len(n)
    return np.concatenate(values), np.bincount(np.concatenate(owners), minlength=rows)


def _roots_of(parents: DataFrame) -> DataFrame:
    """(node, parent) with each parent replaced by the root of its chain, by doubling."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = cut(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b); the root is the least node of a component.

    Every node takes its least neighbour below it as its parent, and the roots of these trees are
    put in the place of their nodes, which leaves far fewer edges, until none is left.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        parents = _roots_of(edges.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "node"))
        labels = cut(labels.join(parents.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        ends = edges.join(parents.withColumnRenamed("node", "a"), "a").select(F.col("parent").alias("a"), "b")
        ends = ends.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("q")), "b", "left").select("a", F.coalesce("q", "b").alias("b"))
        edges = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    return labels


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, text_id, n_text_links.

    ``text_id`` is the least id among the copies of a text, ``class_id`` the least id among all texts
    that links connect. ``n_links`` counts the other documents with a similarity of at least
    ``percent`` / 100, copies included; ``n_text_links`` counts different texts.
    """
    return _joined(docs, doc_id, text, percent, recall).drop("whole", "class_node")


def _joined(docs: DataFrame, doc_id: str, text: str, percent: int, recall: float) -> DataFrame:
    """``join`` with the hash of each row's text. A text's node (``rep``) is a number of its own, as ids can repeat."""
    bands, rows = banding(percent / 100, recall)
    signed = cut(signatures(docs, doc_id, text, bands, rows))
    texts = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "whole")).alias("least"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = cut(texts.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), F.col("least.doc_id").alias("text_id"), F.col("least.whole").alias("whole"), "size", "n", "bands"))
    banded = texts.select("rep", "n", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("members")).where("members > 1")
    members = cut(banded.join(least, "band").select("band", "rep", "n", "least"))
    named = components(members.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    named = named.join(texts.select("rep", "n", "size", "text_id", "whole"), "rep")
    loads = named.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).alias("parts"))
    blocks = named.join(loads, "root").select("rep", "size", "text_id", "whole", "parts", F.xxhash64("root", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))
    blocks = cut(blocks)
    # Units: each block with itself, and each two blocks that a band has in common.
    wide = members.select("band", "rep").join(blocks.where("parts > 1"), "rep").select("band", "rep", "size", "text_id", "whole", "block")
    other = wide.select("band", F.col("block").alias("block2")).distinct()
    across = wide.join(other, "band").where("block != block2").select("rep", "size", "text_id", "whole", "block", "block2").distinct()
    unit = F.xxhash64(F.least("block", "block2"), F.greatest("block", "block2")).alias("unit")
    both = across.select("rep", "size", "text_id", "whole", unit, F.when(F.col("block") < F.col("block2"), 1).otherwise(2).alias("side"))
    shipped = both.union(blocks.select("rep", "size", "text_id", "whole", F.xxhash64("block"), F.lit(0)))
    bodies = docs.select(F.col(doc_id).alias("text_id"), _whole(text).alias("whole"), F.col(text).alias("text")).where("text_id is not null")
    # Repeated rows must not repeat in a unit.
    held = bodies.join(shipped, ["text_id", "whole"]).repartition("unit").sortWithinPartitions("unit", "rep").dropDuplicates(["unit", "rep"]).sortWithinPartitions("unit", "rep")
    found = cut(held.select("rep", "unit", "side", "size", "text").mapInArrow(_units(percent), "rep long, n_texts long, n_docs long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    labels = labels.join(texts.select("rep", "text_id"), "rep")
    least_id = labels.groupBy("root").agg(F.min("text_id").alias("class_id"))
    labels = labels.join(least_id, "root").select("rep", "root", "class_id")
    by_text = texts.select("k1", "k2", "rep", "text_id", "size").join(counts, "rep", "left").join(labels, "rep", "left")
    out = signed.select("doc_id", "whole", "k1", "k2").join(by_text, ["k1", "k2"]).select(
        "doc_id",
        "whole",
        F.coalesce("root", "rep").alias("class_node"),
        F.coalesce("class_id", "text_id").alias("class_id"),
        (F.col("size") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"),
        "text_id",
        F.coalesce("n_texts", F.lit(0)).alias("n_text_links"),
    )
    kind = docs.schema[doc_id].dataType
    null, zero = F.lit(None).cast(kind), F.lit(0).cast("long")
    none = docs.where(F.col(doc_id).isNull()).select(null.alias("doc_id"), _whole(text).alias("whole"), F.lit(None).cast("long").alias("class_node"), null.alias("class_id"), zero.alias("n_links"), null.alias("text_id"), zero.alias("n_text_links"))
    return out.unionByName(none)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A document of each class with its least id, with all columns; those without an id stay.

    Where several texts of a class have that id, the one with the least hash stays; of repeated rows one.
    """
    found = _joined(docs, doc_id, text, THRESHOLD_PERCENT, TARGET_RECALL).where("doc_id = class_id")
    kept = found.groupBy(F.col("class_node").alias("_class"), F.col("doc_id").alias("_id")).agg(F.min("whole").alias("_whole")).drop("_class")
    packed = pack(docs, _id=F.col(doc_id), _whole=_whole(text))
    with_id = packed.join(kept, ["_id", "_whole"], "left_semi").dropDuplicates(["_id", "_whole"])
    return unpack(with_id.unionByName(packed.where("_id is null")), docs.columns, {})
