"""Exact inner-product search of many queries, by blocks and matrix products.

Vectors are packed into blocks, one row each, and every block of queries meets every block of the
corpus: the product of two blocks yields the k best of the block for each query, and a window takes
the best of all. What is shuffled is k rows per query and corpus block, never a pair per vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators.bm25 import ranked
from skein.plans.lineage import cut

BLOCK = 4096
#: Queries of a block that are scored at once, and queries up to which their blocks are sent to those of the corpus.
AT_ONCE, BROADCAST_QUERIES = 128, 4 * BLOCK
#: Texts that are embedded at once by their words.
TEXTS = 512


def _packed(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Rows of up to BLOCK vectors: ids, and the vectors as float32 bytes with their width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4")
                columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id")), pa.array([values.tobytes()], pa.binary()), pa.array([len(values) // part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"{prefix}_ids", f"{prefix}_vectors", f"{prefix}_width"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null and size(vector) > 0")
    return rows.mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_vectors binary, {prefix}_width int")


def search(queries: DataFrame, corpus: DataFrame, k: int, query_vector: str = "vec", corpus_vector: str = "vec") -> DataFrame:
    """(qid, rank, id, score) of ``queries`` (qid, vec) in ``corpus`` (id, vec), scores to six decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                widths = batch.column("q_width")[i].as_py(), batch.column("c_width")[i].as_py()
                if widths[0] != widths[1]:
                    raise ValueError("queries and corpus have vectors of different lengths")
                unpack = lambda name, i=i, width=widths[0]: np.frombuffer(batch.column(f"{name}_vectors")[i].as_buffer(), "<f4").reshape(-1, width).astype(np.float64)  # noqa: B023, E731
                qids, ids = (batch.column(f"{name}_ids")[i].values for name in "qc")
                order = np.argsort(ids.to_numpy(), kind="stable")
                ids, known, asked = ids.to_numpy()[order], unpack("c")[order].T, unpack("q")
                take = min(k, len(ids))
                for start in range(0, len(asked), AT_ONCE):
                    scores = np.round(asked[start : start + AT_ONCE] @ known, 6)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :take]
                    found = qids.slice(start, len(scores)).to_numpy()
                    columns = [pa.array(np.repeat(found, take)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "score"])

    # Full blocks of queries, and as few as there can be: each meets every block of the corpus.
    asked = cut(queries.select("qid", query_vector))
    n = asked.count()
    asked, known = _packed(asked.repartition(n // BLOCK + 1), "qid", query_vector, "q"), _packed(corpus, "id", corpus_vector, "c")
    blocks = known.crossJoin(F.broadcast(asked)) if n <= BROADCAST_QUERIES else cut(known).crossJoin(cut(asked))
    return ranked(blocks.mapInArrow(run, "qid long, id long, score double"), k).select("qid", "rank", "id", "score")


def score_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, id, score) of given pairs (qid, id)."""
    joined = pairs.join(queries.select("qid", F.col("vec").alias("q_vec")), "qid").join(corpus.select("id", F.col("vec").alias("c_vec")), "id")
    product = F.aggregate(F.zip_with("q_vec", "c_vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return joined.select("qid", "id", F.round(product, 6).alias("score"))


def hash_embed(df: DataFrame, text: str = "text", dim: int = 256, out: str = "vec") -> DataFrame:
    """``df`` with a lexical stand-in for an embedding: words counted by CRC-32 bucket, unit length.

    A text without words, or a null one, has the zero vector. TEXTS of them are counted at once, however many come in a batch.
    """
    words = tx.tokens(F.coalesce(F.col(text), F.lit("")))
    buckets = F.transform(words, lambda w: (F.crc32(w) % dim).cast("int"))

    def fold(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in series:
            for start in range(0, len(batch), TEXTS):
                part = batch.slice(start, TEXTS)
                sizes = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                cells = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.arange(len(part)) * dim, sizes)
                counts = np.bincount(cells, minlength=len(part) * dim).reshape(len(part), dim).astype(np.float32)
                norms = np.linalg.norm(counts, axis=1, keepdims=True)
                vectors = (counts / np.where(norms > 0, norms, 1)).astype(np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(vectors.ravel()))

    return df.withColumn(out, F.arrow_udf(fold, "array<float>")(buckets))


def encode(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "vec") -> DataFrame:
    """``df`` with the vectors of an injected encoder, which is called on batches of texts."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in series:
            yield pd.Series(list(np.asarray(encoder(part.fillna("").tolist()), dtype=np.float32)))

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def crc_bucket(word: str, dim: int = 256) -> int:
    """The bucket of one word, for callers that embed a query without Spark."""
    return zlib.crc32(word.encode()) % dim
