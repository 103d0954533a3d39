"""The pipeline against its stages by brute force."""

from __future__ import annotations

import numpy as np
import sentencepiece

import corpus_pipeline
from skein.llm import pii
from skein.llm.queries import piece_model
from tests.llm import brute


def test_stages_by_brute_force(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = brute.quality(docs)
    classes, _ = brute.classes({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if classes[d["doc_id"]] == d["doc_id"]]
    named = pii.pseudonymise(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")).collect()
    texts = {r["doc_id"]: r["text"] for r in named}
    docs = [d | {"text": texts[d["doc_id"]]} for d in docs]
    copies = brute.mix(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    wanted = []
    for d in docs:
        ids = library.encode(d["text"], add_bos=True, add_eos=True)
        wanted += [(d["doc_id"], d["lang"], d["source"], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids) == d["text"])] * copies[d["doc_id"]]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    found = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["lossless"]) for r in rows]
    assert len(found) > 50 and sorted(found) == sorted(wanted)


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
