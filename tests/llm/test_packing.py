"""Packing against the library's ids and against what a packing must be."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.byte_tokeniser())


def test_the_query_packs_every_id_once(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_packing(spark, sf_dir).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    covered, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]].append((r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at
            at += n
        assert at == len(own)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    assert len(filled) <= -(-sum(map(len, ids.values())) // 2048) + 11 * 4


def test_ids_are_the_library_s(library):
    rng = random.Random(5)
    letters = " \n\t'slx1.é　漢\x1c\x85<|>"
    texts = [None, "", " ", "  a  b ", "a　b", "a\xa0 b", "<|endoftext|> b<|endoftext|>", "it's  we'll \n\n x", "a" * 3000, *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1000))]
    flat, counts = packing.Tokeniser(library.to_str()).encode(pa.array(texts))
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in wanted] and flat.tolist() == [i for x in wanted for i in x]


def by_rule(lengths: list[int], tokens: int, linear: int) -> set[tuple[int, ...]]:
    """The same assignment, with lists and without cutting whole sequences off first by a formula."""
    room = packing.capacities(sum(lengths), tokens).tolist()
    size, cost, out, left = list(room), [0] * len(room), set(), []
    place = 0
    for i, n in enumerate(lengths):
        start = 0
        while n - start >= tokens:
            out.add((i, start, tokens, place, 0))
            room[place], place, start = 0, place + 1, start + tokens
        if n > start:
            left.append((i, start, n - start))
    while left:
        left.sort(key=lambda x: (-x[2], x[0], x[1]))
        i, start, n = left.pop(0)
        fit = [b for b in range(len(room)) if room[b] >= n] or [b for b in range(len(room)) if room[b]]
        b = min(fit, key=lambda b: (cost[b], b))
        part = min(n, room[b])
        out.add((i, start, part, b, size[b] - room[b]))
        if part < n:
            left.append((i, start + part, n - part))
        room[b] -= part
        cost[b] += part * (linear + part)
    return out


def test_assignment_by_rule():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.choice([1, 2, rng.randrange(1, 90), rng.randrange(1, 20)]) for _ in range(rng.randrange(1, 60))]
        found = packing.assign(np.array(lengths), 16, 7)
        assert {tuple(x) for x in found.tolist()} == by_rule(lengths, 16, 7) and len(found) == len(by_rule(lengths, 16, 7))


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 2000)
    cost = lambda pieces, n: np.bincount(pieces[:, 3], weights=pieces[:, 2] * (200.0 + pieces[:, 2]), minlength=n)
    n = int(lengths.sum()) // 2048
    ours = cost(packing.assign(lengths, linear=200), n)[:n]
    flat = np.repeat(np.arange(len(lengths)), lengths)[: n * 2048].reshape(n, 2048)
    plain = np.array([sum(float(c) * (200 + c) for c in np.unique(x, return_counts=True)[1]) for x in flat])
    assert ours.std() < plain.std() / 3


def test_sequences_and_small_groups(spark, library):
    rows = [(i, "word " * (i * 37 % 900) + "end", "own") for i in range(40)] + [(None, None, "own"), (7, "again", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    pieces = packing.pack(df, packing.tokeniser(df, queries.byte_tokeniser()), group_tokens=3000).cache()
    made = packing.sequences(pieces)
    assert made.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert made.where("padded_to != n_tokens").count() == 0
    assert made.agg(F.sum("n_tokens")).first()[0] == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert pieces.where("doc_id is null").select("length", "doc_tokens").collect() == [(1, 1)]
