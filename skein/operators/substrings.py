"""Which texts contain which needles, by an index of byte grams in place of comparing all with all.

UTF-8 keeps substrings: a text contains a needle if its bytes do. A needle of up to WIDTH bytes is one
gram of its own length, and a text has it if it has the gram. A longer one is found by the rarest of
about EACH of its WIDTH-byte grams:

1. Grams of the needles are collected for a filter, as 64-bit numbers, if they are counted to be at most
   FILTER_GRAMS; with more of them texts hand over all grams of the widths that needles have.
2. Texts are cut into distinct grams in Arrow batches; only grams that some needle has leave the task.
3. Of each long needle the gram that the fewest texts have is its key; one that no text has rules it out.
4. Grams of texts and keys of needles meet by an equi-join; candidates of long needles are verified on the
   texts, with the candidates broadcast if they are counted to be few, and by a join otherwise.

Defined results: null texts and needles, and empty needles, match nothing; repeated needles count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.lineage import cut

WIDTH = 8
FILTER_GRAMS = 2_000_000
#: Candidate pairs, and characters of their needles, that are broadcast.
FEW_PAIRS = 100_000
FEW_CHARS = 32_000_000
SLICE_BYTES = 1 << 20
#: Grams of a long needle that are looked for, of which the rarest becomes its key.
EACH = 16
ALIKE = 1 << 20


def _windows(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each window of ``width`` bytes that lies within one text."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number = np.zeros(n, np.uint64)
    for k in range(width):
        number = (number << np.uint64(8)) | raw[k : k + n]
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = owner[:n] == owner[width - 1 :]
    return owner[:n][inside], number[inside]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _spaced(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each needle's windows, in order, about EACH at equal distances."""
    count = np.bincount(owner, minlength=int(owner.max()) + 1) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    kept = place % np.maximum(count // EACH, 1)[owner] == 0 if len(owner) else np.zeros(0, bool)
    return owner[kept], number[kept]


class Wanted:
    """Numbers of grams by width, with a table of their low bits before they are looked up."""

    def __init__(self, grams: dict[int, np.ndarray]) -> None:
        self.grams = grams
        self.table = {}
        for width, numbers in grams.items():
            self.table[width] = np.zeros(ALIKE, bool)
            self.table[width][self._low(numbers)] = True

    @staticmethod
    def _low(numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def has(self, width: int, numbers: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[width][self._low(numbers)])
        known = self.grams[width]
        at = np.minimum(np.searchsorted(known, numbers[maybe]), len(known) - 1)
        return maybe[known[at] == numbers[maybe]]


def grams(rows: DataFrame, widths: list[int], wanted: Broadcast | None = None, own: bool = False) -> DataFrame:
    """(id, width, gram): distinct grams of rows (id, text), of the given widths; ``own``: of the width that the row needs as a needle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
                ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
                size = np.diff(ends, prepend=0)
                for width in widths:
                    owner, number = _windows(raw, ends, width)
                    if own:
                        right = np.minimum(size[owner], WIDTH) == width
                        owner, number = _spaced(owner[right], number[right])
                    if wanted is not None:
                        hit = wanted.value.has(width, number)
                        owner, number = owner[hit], number[hit]
                    order = np.lexsort((number, owner))
                    owner, number = owner[order], number[order]
                    new = np.ones(len(owner), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
                    owner, number = owner[new], number[new]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(np.full(len(owner), width), pa.int32()), pa.array(number.view(np.int64))], names=["id", "width", "gram"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, width int, gram long")


def containing(texts: DataFrame, needles: DataFrame, key: str = "id", text: str = "text", needle: str = "needle") -> DataFrame:
    """(key, needle): every text and needle that it contains, once."""
    spark = texts.sparkSession
    given = needles.select(F.col(needle).alias("needle")).where("needle is not null and needle != ''").distinct()
    named = cut(given.withColumn("id", F.monotonically_increasing_id()))
    own = cut(grams(named.select("id", F.col("needle").alias("text")), list(range(1, WIDTH + 1)), own=True))
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    wanted = own.select("width", "gram").distinct()
    # One job says which grams there are, or that there are too many; they are a few numbers each.
    table = wanted.limit(FILTER_GRAMS + 1).toPandas()
    shared, widths = None, sorted(int(w) for w in table["width"].unique())
    if len(table) > FILTER_GRAMS:
        widths = sorted(r["width"] for r in own.select("width").distinct().collect())
    elif widths:
        shared = spark.sparkContext.broadcast(Wanted({w: np.sort(part["gram"].to_numpy().view(np.uint64)) for w, part in table.groupby("width")}))
    found = grams(rows, widths, shared)
    found = cut(found) if shared is not None else found
    counts = found.join(wanted, ["width", "gram"], "left_semi").groupBy("width", "gram").agg(F.count("*").alias("n"))
    keys = own.withColumnRenamed("id", "_needle").join(counts, ["width", "gram"]).groupBy("_needle").agg(F.min(F.struct("n", "width", "gram")).alias("x"))
    # A needle of up to WIDTH bytes has one gram; of a longer one all have to be there.
    complete = own.withColumnRenamed("id", "_needle").join(counts, ["width", "gram"], "left").groupBy("_needle").agg(F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").select("_needle")
    keys = keys.join(complete, "_needle").select("_needle", "x.width", "x.gram")
    pairs = found.join(keys, ["width", "gram"]).join(named.select(F.col("id").alias("_needle"), "needle"), "_needle")
    pairs = cut(pairs.select("id", "needle").distinct())
    short = pairs.where(F.octet_length("needle") <= WIDTH)
    long = pairs.where(F.octet_length("needle") > WIDTH)
    size = long.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= FEW_PAIRS and size["chars"] <= FEW_CHARS
    verified = rows.join(F.broadcast(long) if few else long, "id").where(F.col("text").contains(F.col("needle"))).select("id", "needle")
    return short.unionByName(verified).distinct().withColumnRenamed("id", key)
