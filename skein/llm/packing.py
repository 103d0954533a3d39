"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Each document becomes token ids and an end id. Its cost in a sequence is estimated as linear in its length
(projections) plus quadratic (attention, which stays within a document). Documents are packed in groups of
about GROUP_TOKENS ids: in descending order of length each goes whole to the sequence of the lowest cost so
far that has room for it. Where none has, as much as fits goes to the lowest-cost sequence with room left,
and the rest is a document to place again. Whole sequences are cut off documents that are longer first.

A group has exactly as many full sequences as its tokens fill. What is left, less than one sequence, makes
sequences of its tokens' binary digits (1,024, 256, ...), since a sequence of a power of two is not padded;
so nothing is padded at all, at the price of at most eleven short sequences a group.

Ids come from a tokeniser of the ``tokenizers`` library. With a byte-level one, a slice of texts is cut into
words before each blank that follows something that is no white space, where no token can span the cut, and
equal words of a slice are encoded once; with others, whole texts are encoded.

Plan: one pass in Arrow batches; nothing is shuffled, broadcast but the tokeniser's file (1.5 MB) or
collected, as groups are made from the rows that a task reads. So a task that is run again makes its own
sequences again, and no key, source or group of copies can meet in one task. Memory is that of one group,
or of one document if it is longer.

Defined results: a null text is an empty one and has the end id alone. Rows with equal or null ids are
documents of their own. An empty table gives no pieces. Other columns are not carried. Which documents
share a sequence depends on how rows are partitioned, the tokens of a document do not.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import text_arrays

TOKENS = 2048
#: Ids and documents that close a group.
GROUP_TOKENS = 1 << 21
GROUP_DOCS = 1 << 15
END = 1
#: Of a token: cost of the projections in units of the attention with one other token, at a width of 4,096.
LINEAR = 6 * 4096
#: Bytes of text whose equal words are encoded once, and words that are encoded in a row.
SLICE_BYTES = 1 << 23
JOIN = 256
#: Sequences of a group that are handed over at once.
AT_ONCE = 512


class Tokeniser:
    """A tokeniser's file, as text; made once in each process that uses it."""

    def __init__(self, source: str) -> None:
        self.source = source

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        return Tokenizer.from_str(self.source)

    @functools.cached_property
    def token_bytes(self) -> np.ndarray | None:
        """Bytes of text that each token stands for, if words can be encoded apart: byte-level, without a normaliser or an added blank."""
        made = json.loads(self.source)
        splits = made.get("pre_tokenizer") or {}
        if made.get("normalizer") or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
            return None
        sizes = {i: len(token) for token, i in made["model"]["vocab"].items()}  # a letter of a token is a byte
        sizes |= {x["id"]: len(x["content"].encode()) for x in made["added_tokens"]}
        out = np.zeros(max(sizes) + 1, np.int64)
        out[list(sizes)] = list(sizes.values())
        return out

    def __getstate__(self) -> dict:
        return {"source": self.source}

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _word_ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words. Those that begin with a blank are encoded JOIN in a row, as they would be cut apart again."""
        raw, ends = text_arrays.raw_bytes(words)
        joined = np.append(raw[ends[:-1]] == 0x20, False)
        fresh = ~joined[:-1]
        fresh[1:] |= ~joined[:-2]
        fresh[:1] = True
        fresh[np.flatnonzero(joined)[::JOIN]] = True
        begins = np.flatnonzero(fresh)
        edges = np.append(ends[begins], len(raw)).tolist()
        data = raw.tobytes()
        flat, _ = self._ids([data[a:b].decode() for a, b in itertools.pairwise(edges)])
        last = np.searchsorted(np.cumsum(self.token_bytes[flat]), ends[1:]) + 1
        return flat, np.diff(last, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.token_bytes is None:
            return self._ids(pc.fill_null(texts, "").to_pylist())
        raw, offsets = text_arrays.raw_bytes(texts)
        words, per_text = _words(raw, offsets)
        coded = words.dictionary_encode()
        flat, sizes = self._word_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        return _gather(flat, sizes, which), np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=sizes[which], minlength=len(texts)).astype(np.int64)


def tokeniser(df: DataFrame, path: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(Tokeniser(Path(path).read_text(encoding="utf-8")))


@functools.cache
def _is_space() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x110000)])


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, and how many each text has: a word begins at a text's begin and at a blank after anything but white space."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    solid = ~_is_space()[points]
    begin = raw == 0x20
    begin[1:] &= solid[np.cumsum((raw[:-1] & 0xC0) != 0x80) - 1] if len(raw) != len(points) else solid[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(begin)
    ends = np.append(at, len(raw))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
    return words, np.diff(np.searchsorted(at, offsets))


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, which is made of runs of ``sizes``, one after the other."""
    begins, counts = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)]


def _with_end(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.insert(flat, np.cumsum(counts), END)


def capacities(total: int, tokens: int = TOKENS) -> np.ndarray:
    """Sequences that ``total`` ids fill exactly: full ones, then one for each binary digit of the rest."""
    rest = total % tokens
    return np.array([tokens] * (total // tokens) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def assign(lengths: np.ndarray, tokens: int = TOKENS, linear: int = LINEAR) -> np.ndarray:
    """Pieces of documents of ``lengths`` ids: rows of document, start, length, sequence and offset in it."""
    lengths = np.asarray(lengths, np.int64)
    room = capacities(int(lengths.sum()), tokens)
    cost = np.zeros(len(room), np.int64)
    size = room.copy()
    whole = lengths // tokens
    n_whole = int(whole.sum())
    owner = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [np.stack([owner, nth * tokens, np.full(n_whole, tokens), np.arange(n_whole), np.zeros(n_whole, np.int64)], axis=1)]
    room[:n_whole] = 0
    waiting = [(-int(n), i, int(w) * tokens) for i, (n, w) in enumerate(zip(lengths % tokens, whole, strict=True)) if n]
    heapq.heapify(waiting)
    never = np.iinfo(np.int64).max
    made = []
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        best = int(np.where(room >= n, cost, never).argmin())
        if room[best] < n:
            best = int(np.where(room > 0, cost, never).argmin())
            part = int(room[best])
            heapq.heappush(waiting, (part - n, doc, start + part))
            n = part
        made.append((doc, start, n, best, int(size[best] - room[best])))
        room[best] -= n
        cost[best] += n * (linear + n)
    pieces.append(np.array(made, np.int64).reshape(-1, 5))
    return np.concatenate(pieces)


def _packed(flat: np.ndarray, lengths: np.ndarray, owners: pa.Array, first: int, tokens: int, linear: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one group, in the order of their sequences, which are numbered from ``first`` on."""
    begins = np.cumsum(lengths) - lengths
    pieces = assign(lengths, tokens, linear)
    pieces = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))]
    n_sequences = int(pieces[-1, 3]) + 1
    bounds = np.searchsorted(pieces[:, 3], np.append(np.arange(0, n_sequences, AT_ONCE), n_sequences))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        doc, start, length, sequence, offset = pieces[a:b].T
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.arange(ends[-1]) + np.repeat(begins[doc] + start - ends[:-1], length)].astype("<u4")
        packed = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
        longs = [pa.array(x, pa.int64()) for x in (start, length, lengths[doc], first + sequence, offset)]
        yield pa.RecordBatch.from_arrays([owners.take(pa.array(doc)), *longs, packed], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, model: Broadcast, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS, linear: int = LINEAR, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and packed ids (little-endian, unsigned, 32 bits) of every piece."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tokeniser = model.value
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            flat, lengths, owners = (np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held]))
            held.clear()
            yield from _packed(flat, lengths, owners, number, tokens, linear)
            number += len(capacities(int(lengths.sum()), tokens))

        for batch in batches:
            for part in text_arrays.slices(batch, "text", SLICE_BYTES):
                flat, counts = t.encode(part.column("text"))
                held.append((_with_end(flat, counts), counts + 1, part.column("doc_id")))
                if sum(len(x[0]) for x in held) >= group_tokens or sum(len(x[1]) for x in held) >= GROUP_DOCS:
                    yield from close()
        if held:
            yield from close()
        text_arrays.give_back()

    return slim.mapInArrow(run, schema)


def sequences(pieces: DataFrame, tokens: int = TOKENS, linear: int = LINEAR) -> DataFrame:
    """One row per sequence: its ids, the lengths of its documents in order, its cost, and the tokens it is padded to."""
    one = F.struct("offset", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    cost = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"] * (linear + x["length"]))
    made = whole.select("sequence_id", n.alias("n_tokens"), cost.alias("cost"), F.transform("parts", lambda x: x["length"]).alias("doc_lengths"), F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "").alias("hex"))
    even = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return made.select("sequence_id", "n_tokens", F.when(even, F.col("n_tokens")).otherwise(F.lit(tokens).cast("long")).alias("padded_to"), "cost", "doc_lengths", F.unhex("hex").alias("ids"))
