from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import piece_bpe, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return piece_bpe.Vocabulary.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, texts):
    own, library = both
    ids, counts = piece_bpe.encode_texts(own, pa.array(texts))
    decoded = piece_bpe.decode_ids(own, ids.astype(np.int64), counts).to_pylist()
    ends = np.cumsum(counts)
    for text, end, n, back in zip(texts, ends, counts, decoded, strict=True):
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert ids[end - n : end].tolist() == wanted, text[:80]
        assert back == library.decode(wanted), text[:80]


def test_fixed_texts(both):
    same(both, ["", " ", "  ", "a", "a  b\n c ", "\n\n", "▁", "▁▁a ▁", "日本語 テスト", "🙂 x", "\x00a", "aaaa" * 500, " " * 100, "a" + " " * 40 + "b", "<s> </s> <unk> <0x0A>", " " * 1000 + "z" * 3000])


def test_pieces_and_long_words(both):
    rnd = random.Random(5)
    pieces = [both[1].id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    same(both, ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(3000)])
    same(both, ["".join(rnd.choice("abcdeinrst") for _ in range(rnd.randint(200, 700))) for _ in range(60)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abethin o▁\n.Z01$="), st.characters(codec="utf-8")), max_size=80), min_size=1, max_size=5))
def test_any_text(both, texts):
    same(both, texts)


def test_decoding_any_ids(both):
    own, library = both
    rnd = random.Random(7)
    some = [[rnd.choice([0, 1, 2, 300, 28705, rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(0, 9))] for _ in range(2000)]
    counts = np.array([len(s) for s in some])
    out = piece_bpe.decode_ids(own, np.array([i for s in some for i in s], np.int64), counts).to_pylist()
    assert out == [library.decode(s) for s in some]


def test_query(spark, sf_dir, both):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = both[1].encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()


def test_words_of_a_megabyte(both):
    """Long unbroken runs go through the same rounds, exactly and in bounded time."""
    rnd = random.Random(9)
    pieces = [p for i in range(300, 32000) if "▁" not in (p := both[1].id_to_piece(i)) and p.isalpha() and p.isascii()]
    start = time.time()
    same(both, ["".join(rnd.choice("abcdeinrst") for _ in range(1_000_000)), "".join(rnd.choice(pieces) for _ in range(200_000)), "z" * 1_000_000])
    assert time.time() - start < 60
