"""Vector codes: product quantisation in exact integers.

Each component x becomes the integer floor(SCALE * x). A vector is cut into PARTS equal parts; each part
position has a codebook of at most ENTRIES entries, which begins as that part of the vectors with the least
ids. A round broadcasts the codebooks, assigns every part to its nearest entry (squared Euclidean distance,
ties to the first) and replaces each entry by floor(sum / count) of its parts; unused entries stay.

Plan: the codebooks (PARTS x ENTRIES short integer rows, a size fixed by the parameters) are broadcast. An
Arrow batch takes distances to all entries at once as ``|c|^2 - 2 x.c``, ``|x|^2`` being the same for all of
them, by an int64 matrix product for each part; numpy's argmin takes the first. A task adds up its own parts by
entry and hands over one row an entry it has met, which one grouped shuffle merges; PARTS x ENTRIES rows go to
the driver each round. So whatever the number of equal vectors, no key meets in one task. The vectors are read
once a round and never shuffled. The codes are written once to the checkpoint folder; sums by label are
broadcast where they are counted to be few, and joined by a salted key otherwise.

Defined results: rows whose vector is null, is empty or holds a null, infinite or NaN component are dropped,
as are vectors whose length is not that of the first kept one (by id) or no multiple of PARTS. Components are
held within -LIMIT and LIMIT (so that distances fit 64 bits), which |x| below 32,768 never meets. Null ids come
after all others; equal ids are ordered by their vectors. With fewer vectors than ENTRIES the codebooks are
shorter; an empty table gives no rows. Repeated rows get equal results. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMIT = 1 << 27
#: Vectors that are worked on at once.
ROWS = 4096
#: Labels whose sums are broadcast; beyond, they are joined.
BROADCAST_LABELS = 100_000
SALTS = 32
_MOST = (1 << 63) - 1


def _fine(vector: Column, parts: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & ~bad


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, vector (doubles) and label of the rows that have a code."""
    named = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    kept = named.where(_fine(F.col("vector"), parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    return kept.where(F.size("vector") == (first[0]["n"] if first else 0))


def _integers(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(pc.list_flatten(vectors).to_numpy(zero_copy_only=False), np.float64)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(len(vectors), -1)


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts x entries x components, from the vectors of the least ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    whole = _integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())))
    return whole.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def nearest(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer vectors (rows x parts x components): each part's first nearest entry, and the squared distance."""
    n, parts, _ = vectors.shape
    index, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        x, c = vectors[:, p, :], codebooks[p]
        beside = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
        index[:, p] = beside.argmin(axis=1)
        error[:, p] = beside[np.arange(n), index[:, p]] + (x * x).sum(axis=1)
    return index, error


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            some = batch.slice(start, ROWS)
            yield some, _integers(some.column("vector")).reshape(some.num_rows, parts, -1)


def _sums(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """part, entry, n and the component sums of the parts that are nearest to that entry."""
    shared = kept.sparkSession.sparkContext.broadcast(codebooks)
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, x in _blocks(batches, parts):
            at = (nearest(x, shared.value)[0] + np.arange(parts) * entries).ravel()
            order = np.argsort(at, kind="stable")
            met, first, times = np.unique(at[order], return_index=True, return_counts=True)
            total[met] += np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
            n[met] += times
        met = np.flatnonzero(n)
        columns = [met // entries, met % entries, n[met], *total[met].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *(f"s{k}" for k in range(width))])

    made = kept.select("vector").mapInArrow(run, "part long, entry long, n long" + "".join(f", s{k} long" for k in range(width)))
    return made.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in made.columns[2:]))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds."""
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        after = books.copy()
        for r in _sums(kept, books).collect():
            after[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]
        books = after
    return books


def encode(kept: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error of every usable vector."""
    shared = kept.sparkSession.sparkContext.broadcast(codebooks)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _blocks(batches, len(shared.value)):
            index, error = nearest(x, shared.value)
            code = digits[index[:, 0]]
            for p in range(1, index.shape[1]):
                code = np.char.add(code, digits[index[:, p]])
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, codebooks: np.ndarray, code: str = "code", out: str = "vector") -> DataFrame:
    """``codes`` with the vector (doubles) that each code stands for; a null code has none."""
    if not codebooks.size:
        return codes.withColumn(out, F.lit(None).cast("array<double>"))
    books = F.lit((codebooks / SCALE).tolist())
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(books, F.lit(p)), index(p)) for p in range(len(codebooks))]
    return codes.withColumn(out, F.concat(*parts))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors over each label, nulls together; a sum beyond a long is the greatest long."""
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy("label").agg(exact.alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    salts = 1 if few else SALTS
    left = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    right = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    on = F.col("label").eqNullSafe(F.col("_label")) & (left["_salt"] == right["_salt"])
    return left.join(F.broadcast(right) if few else right, on).drop("_salt", "_label")


def codebook_digest(codebooks: np.ndarray) -> Column:
    return F.sha2(F.lit(",".join(str(x) for x in codebooks.ravel().tolist())), 256)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    kept = usable(vectors, vec_id, vector, label)
    books = train(kept)
    coded = with_label_error(cut(encode(kept, books)))
    return coded.select("vec_id", "code", "error", "label_error", codebook_digest(books).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, a round after the other."""
    assigned = """a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.label, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM pieces p JOIN b{r} b ON p.part = b.part) GROUP BY ALL)"""
    # Columns of one vector and part are equal only if its rows are; vec_id is unique in the tables.
    moved = """b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
  SELECT part, entry, list(v ORDER BY i) AS c FROM (
    SELECT part, entry, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS v FROM (
      SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY part, entry, i))
  GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""
    steps = [assigned.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1), assigned.format(r=r + 1)]
    body = ",\n".join(steps)
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM pieces
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}),
{body},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


ORACLE = oracle()
