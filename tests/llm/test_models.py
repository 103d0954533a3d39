"""Trained operators: held-out accuracy on the driver's rows, and their parts on small ones."""

from __future__ import annotations

import os
import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import language_id, licenses, quality_classifier, queries

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("the test tables are not here")
    return spark.read.parquet(f"{LARGER}/documents.parquet")


def test_language_held_out(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_kernel_is_the_share_of_common_grams():
    texts = ["abc abd", "abd", "zzz"]
    marks = language_id.Landmarks.learn(texts)

    def by_hand(text: str) -> set[str]:
        padded = f" {text} "
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {" "}

    sets = [by_hand(t) for t in texts]
    kernel = marks.kernel(pa.array(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert kernel[i, j] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), abs=1e-6)


def test_scores_are_kernel_ridge_regression():
    """The inverted lists give what the kernels with all landmarks give, solved by hand."""
    texts = ["the cat and the dog", "a dog in the house", "der hund und die katze", "ein haus und der hund"] * 5
    labels = ["en", "en", "de", "de"] * 5
    model = language_id.fit_rows(texts, labels)
    asked = ["the house", "die katze", "hund and house"]

    def sets(text: str) -> set[str]:
        padded = f" {text} "
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {" "}

    order = [i for lang in ("de", "en") for i in range(len(labels)) if labels[i] == lang]
    known = set().union(*map(sets, texts))
    kernel = lambda x, y: np.array([[len(sets(a) & sets(b)) / np.sqrt(len(sets(a) & known) * len(sets(b) & known)) for b in y] for a in x])
    marks = [texts[i] for i in order]
    k_nm, k_mm = kernel(texts, marks), kernel(marks, marks)
    target = np.array([[1.0, -1.0] if x == "de" else [-1.0, 1.0] for x in labels])
    solved = np.linalg.solve(k_nm.T @ k_nm + len(texts) * language_id.RIDGE * k_mm + 1e-8 * np.eye(len(marks)), k_nm.T @ (target - target.mean(axis=0)))
    wanted = kernel(asked, marks) @ solved + target.mean(axis=0)
    assert np.abs(model.scores(model.marks.kernel(pa.array(asked))) - wanted).max() < 1e-3


def test_many_scripts_and_languages():
    """Chinese and Japanese are told apart by their letters, and so are a hundred invented languages."""
    zh = ["我们今天去图书馆看书", "这个城市的天气很好", "他们在学校里学习中文", "请问你叫什么名字", "我喜欢喝茶和咖啡", "火车站离这里不远"]
    ja = ["今日は図書館で本を読みます", "この町の天気はとても良いです", "彼らは学校で勉強しています", "お名前は何ですか", "私はお茶とコーヒーが好きです", "駅はここから遠くありません"]
    model = language_id.fit_rows(zh[:5] + ja[:5], ["zh"] * 5 + ["ja"] * 5)
    assert [model.languages[i] for i in model.scores(model.marks.kernel(pa.array([zh[5], ja[5]]))).argmax(axis=1)] == ["zh", "ja"]
    rng = np.random.default_rng(5)

    def text(k: int) -> str:
        own = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        return "".join(own[i] if i < 40 else " " for i in rng.integers(0, 45, 120))

    labels = [f"l{k:03d}" for k in range(100) for _ in range(4)]
    model = language_id.fit_rows([text(int(x[1:])) for x in labels], labels)
    found = model.scores(model.marks.kernel(pa.array([text(k) for k in range(100)]))).argmax(axis=1)
    assert np.mean([model.languages[i] == f"l{k:03d}" for k, i in enumerate(found)]) > 0.99


def test_long_lists_are_counted_in_parts(monkeypatch):
    texts = ["the cat and the dog", "a dog in the house", "der hund und die katze", ""]
    marks = language_id.Landmarks.learn(texts[:3])
    whole = marks.kernel(pa.array(texts))
    monkeypatch.setattr(language_id, "LISTED", 3)
    assert np.array_equal(whole, marks.kernel(pa.array(texts)))


def test_scripts_of_many_letters_fit_in_memory():
    """40 languages of long texts in thousands of letters: what is kept and what fitting takes stays below 1 GB."""
    rng = np.random.default_rng(7)

    def text(k: int) -> str:
        return "".join(map(chr, rng.integers(0x4E00 + 150 * k, 0x4E00 + 150 * k + 9000, 10_000)))

    labels = [f"l{k:02d}" for k in range(40) for _ in range(8)]
    texts = [text(int(x[1:])) for x in labels]
    tracemalloc.start()
    model = language_id.fit_rows(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.marks.grams.size > 3_000_000 and peak < 1e9
    assert len(pickle.dumps(model)) < 3e8
    found = model.scores(model.marks.kernels([text(k) for k in range(0, 40, 8)])).argmax(axis=1)
    assert [model.languages[i] for i in found] == [f"l{k:02d}" for k in range(0, 40, 8)]


def test_classifier_against_labels(docs, spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = quality_classifier.classify(docs, weak_labels=True).join(labels, "doc_id").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert np.mean(good[:, None] > bad[None, :]) > 0.93
    assert np.mean(good >= 0.5) > 0.95


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy, cover = [0.95, 0.8, 0.65, 0.9], [0.9, 0.7, 0.9, 0.4]
    votes = np.stack([np.where(rng.random(len(truth)) < c, np.where(rng.random(len(truth)) < a, truth, ~truth), -1) for a, c in zip(accuracy, cover, strict=True)], axis=1).astype(int)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.expectation_maximisation(table, counts.astype(float))
    assert np.abs(model.accuracies() - accuracy).max() < 0.03 and abs(model.prior - 0.7) < 0.03


def test_licenses(docs, spark):
    wanted = {"apache license, version 2.0": "Apache-2.0", "the mit license": "MIT", "gnu general public license, version 3": "GPL-3.0", "cc by-nc 4.0": "CC-BY-NC-4.0"}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in licenses.scan(docs).collect():
        plain = "".join(c for c in texts[r["doc_id"]].lower() if c not in "#*$%&!")
        assert r["licenses"] == sorted({v for k, v in wanted.items() if k in plain})
    model = licenses.train(licenses.sample_negatives(docs))
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert {x[1] for x in model.scan(f"Some words before it.\n\n{notice}\n\nAnd after.")} == {family}
    assert not any(model.scan(x) for x in licenses.NEAR_MISSES)
    broken = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with\nthe License. You may obtain a copy of the License"
    assert {x[1] for x in model.scan(broken)} == {"Apache-2.0"}


def test_license_kin_and_blanks(spark):
    texts = {
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ["BSD-2-Clause"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
        "Released\u00a0under\u00a0the\u2003MIT\u00a0License": ["MIT"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": ["ISC"],
        "Nothing of the kind.": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(df).orderBy("doc_id").collect()] == list(texts.values())


@given(st.lists(st.sampled_from([*(w for rows in licenses.TEMPLATES.values() for t in rows for w in t.split()), "\u00a0", "\n", "\n\n", "...", "--", "\x1c", "x"]), max_size=30), st.sampled_from([" ", "\u00a0", "\t", "\u2028"]))
@settings(max_examples=100, deadline=None)
def test_no_finding_is_passed_by(words, blank):
    """Trigrams of any paragraph are trigrams of the whole text."""
    text = blank.join(words)
    whole = set(licenses._text_grams(pa.array([text]))[0].tolist())
    for part in licenses._parts(text):
        assert set(licenses._text_grams(pa.array([part]))[0].tolist()) <= whole
        assert len(licenses.grams(licenses.tokens([part])[0], 3)) <= len(whole)


def test_calibration(docs):
    assert licenses.train(licenses.sample_negatives(docs)).error < 0.1  # of whole wordings that were not seen


def test_query_by_phrases(spark, sf_dir):
    """op4 over all documents against a plain search for notices."""
    marks = {"apache license, version 2.0": "Apache-2.0", "the mit license": "MIT", "gnu general public license, version 3": "GPL-3.0", "cc by-nc 4.0": "CC-BY-NC-4.0"}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_license_scans(spark, sf_dir).collect():
        plain = "".join(c for c in texts[r["doc_id"]].lower() if c not in "#*$%&!")
        assert r["licenses"] == sorted({v for k, v in marks.items() if k in plain})


def test_several_licenses_in_a_paragraph():
    model = licenses.train(["The committee met in the town hall on Monday and spoke of the new road over the old bridge.\nNothing else was decided."])
    found = lambda text: sorted({x[1] for x in model.scan(text)})
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == ["Apache-2.0", "MIT"]
    assert found("# SPDX-License-Identifier: (MPL-2.0 AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0") == ["BSD-3-Clause", "GPL-2.0", "MPL-2.0"]
    assert found("SPDX-License-Identifier: Apache-2.0 and nothing else\nfor MIT students") == ["Apache-2.0"]
    assert found("Released under the MIT License and the Apache License, Version 2.0") == ["Apache-2.0", "MIT"]
    assert found("It is available under the MIT License and the Apache License, Version 2.0") == ["Apache-2.0", "MIT"]
    for family, notices in licenses.TEMPLATES.items():
        assert all(found(notice) == [family] for notice in notices)
    assert not any(model.scan(x) for x in licenses.NEAR_MISSES)


def test_versions_negations_and_short_forms():
    model = licenses.train(["The committee met in the town hall on Monday and spoke of the new road over the old bridge.\nNothing else was decided."])
    found = lambda text: sorted({x[1] for x in model.scan(text)})
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    wanted = {
        "CC BY 3.0": ["CC-BY-3.0"],
        "CC BY 2.5": [],
        "Licensed under CC BY 2.0": [],
        "This work is licensed under a Creative Commons Attribution 2.5 Generic License": [],
        "Apache License, Version 1.1": ["Apache-1.1"],
        "Licensed under the Apache License, Version 1.0": [],
        "Licensed under the GNU General Public License, version 1": ["GPL-1.0"],
        "Licensed under the GNU General Public License, version 4": [],
        gpl.format("2"): ["GPL-2.0"],
        gpl.format("3"): ["GPL-3.0"],
        gpl.format("2.0"): ["GPL-2.0"],
        gpl.format("7"): [],
        "He was not released under the MIT License terms": [],
        "This file is not licensed under the MIT License but under the Apache License, Version 2.0": ["Apache-2.0"],
        "It was never licensed under the GNU General Public License, version 3. It is licensed under the Mozilla Public License, Version 2.0": ["MPL-2.0"],
        "MIT License": ["MIT"],
        "# The MIT License (MIT)": ["MIT"],
        "Licensed under MIT": ["MIT"],
        "He was licensed under MIT rules for ten years": [],
        "The office of the MIT license board is closed": [],
        "GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": ["GPL-3.0"],
        "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999": ["LGPL-2.1"],
        "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007": ["AGPL-3.0"],
        "                                 Apache License\n                           Version 2.0, January 2004": ["Apache-2.0"],
        "LGPL-2.1-only": ["LGPL-2.1"],
        "SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL-2.1"],
        "SPDX-License-Identifier: LGPL-2.0-only": [],
        "License: BSD-3-Clause": ["BSD-3-Clause"],
    }
    assert {text: found(text) for text in wanted} == wanted
    for family, texts in licenses.TITLES.items():
        assert {text: found(f"Words before it.\n\n{text}\n\nWords after it.") for text in texts} == {text: [family] for text in texts}
