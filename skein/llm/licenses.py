"""License scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are blocks between blank lines, and the single lines of a block. A softmax regression
over hashed word unigrams, bigrams and trigrams assigns each to a license family or to ``unknown``;
it is trained on templates, deterministically damaged copies of them, and paragraphs of the corpus
as ``unknown``. A paragraph can name several families, so a family's probability is a logistic function of its
score over that of ``unknown``. Its slope and offset are fitted on templates that the model which scores them has not
seen (each template is held out whole in one of FOLDS fits), and so is the error of calibration; the final weights
are fitted on all. A family counts if this probability reaches ``MIN_PROBABILITY`` and the paragraph contains
at least ``MIN_CONTAINED`` of the word trigrams of one of its templates, and of those among them that no more
probable confirmed family has, so that kin such as GPL and LGPL do not follow from each other. The
identifiers of an SPDX expression (AND, OR, WITH) are also read one by one.

Further conditions of a confirmation: if trigrams of the template end in a version, the paragraph has one of them, so that
another version's statement is none of this family. Trigrams that a negation precedes by at most REACH words do not
count (``not released under ...``), and neither do those that go on from them. Titles and short
forms (``TITLES``) must be there whole, and those of under four words must be all of a line or block.

Because of that confirmation a document without any template trigram can have no finding; such
documents are passed by after a vectorised look-up, and only the others are split and classified.
Nothing is shuffled but the bounded training sample (NEGATIVES texts at most); the broadcast model
has a fixed size.

Texts that several families share count for the one that has no more than them: the conditions of
BSD-2-Clause are in BSD-3-Clause too, and a document with findings of both has the latter.

Words are runs of letters, digits and dots in lower case. Hyphens, colons and slashes part words;
other characters (as in ``License***``) and dots at the end of a word are ignored. Defined results: a null or empty text has no findings.
Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import text_arrays
from skein.llm.sampling import first_by_hash, fits

NEGATIVES = 200
NEGATIVE_PARAGRAPHS = 1500
BITS = 15
STEPS = 100
MIN_PROBABILITY = 0.5
MIN_CONTAINED = 0.6
FOLDS = 5
REACH = 4
#: Words after which a statement does not hold, as this module compares them.
NEGATIONS = frozenset("not never no neither nor without cannot isnt wasnt arent werent nicht kein keine non ne pas sin nunca".split())
UNKNOWN = "unknown"
#: An SPDX statement and its expression of identifiers.
SPDX = r"SPDX-License-Identifier:[ \t]*([(]*[\w.+:-]+[)]*(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+[(]*[\w.+:-]+[)]*)*)"

#: Notices that the licenses' publishers recommend, and common one-line statements.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "This project is licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "GPL-1.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 1",
        "SPDX-License-Identifier: GPL-1.0-only",
    ],
    "Apache-1.1": [
        "Licensed under the Apache Software License, Version 1.1",
        "Licensed under the Apache License, Version 1.1",
        "SPDX-License-Identifier: Apache-1.1",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0",
        "This program is distributed under the terms of the Artistic License, version 2.0",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "CC-BY-3.0": [
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
        "Licensed under CC BY 3.0",
        "SPDX-License-Identifier: CC-BY-3.0",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Released under the zlib License",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "Released under CC0 1.0 Universal",
    ],
}
#: Titles of license texts, and short forms.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "Apache License 2.0", "License: Apache-2.0", "Licensed under Apache-2.0", "Apache-2.0 License"],
    "Apache-1.1": ["Apache License, Version 1.1", "The Apache Software License, Version 1.1"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "License: MIT", "Licensed under MIT", "Released under MIT", "MIT Licensed"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", "GNU General Public License, version 3", "GPL-3.0-only", "GPL-3.0-or-later", "License: GPL-3.0"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", "GNU General Public License, version 2", "GPL-2.0-only", "GPL-2.0-or-later", "License: GPL-2.0"],
    "GPL-1.0": ["GNU General Public License Version 1, February 1989", "GNU General Public License, version 1"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD-2-Clause": ["BSD 2-Clause License", "License: BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "License: BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "License: MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "ISC": ["ISC License", "License: ISC"],
    "Unlicense": ["The Unlicense"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "License: EPL-2.0"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "Artistic-2.0": ["The Artistic License 2.0"],
}
#: Families whose text holds that of another; a document with both has the first.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Sentences that speak of licenses and name none.
NEAR_MISSES = (
    "A driving licence is required for this position.",
    "All rights reserved. No license is granted.",
    "See the license agreement that came with your device.",
    "The software is provided under a commercial license; contact sales for terms.",
    "The committee granted the broadcaster a new licence for ten years.",
    "Released under the terms that the editors agreed with the authors.",
    "This work was supported by the national science foundation.",
    "Free of charge to any person under the age of twelve.",
    "Version 2.0 of the report was published in May.",
    "Licensed under patents of the manufacturer and its suppliers.",
    "The general public is invited to the annual meeting.",
    "Permission to use the hall must be obtained in writing.",
)


def plain(texts: pa.Array) -> pa.Array:
    """The texts as this module compares them: words of lower-case letters, digits and inner dots, parted by blanks.

    A version's ``.0`` is left out: 2.0 and 2 are one.
    """
    out = pc.replace_substring_regex(pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), ""), r"[-:/\pZ\x00-\x20\x7f-\x{9f}]", " ")
    out = pc.replace_substring_regex(pc.replace_substring_regex(out, r"[^\p{L}\p{M}\p{N}. ]+", ""), r"\.+( |$)", r"\1")
    return pc.replace_substring_regex(out, r"\b([0-9]{1,2})\.0\b", r"\1")


def tokens(texts: list[str]) -> list[list[str]]:
    """The words of each text."""
    return [[w for w in x.split(" ") if w] for x in plain(pa.array(texts, pa.string())).to_pylist()]


def _hash(words: list[str]) -> int:
    return zlib.crc32(" ".join(words).encode())


def grams(words: list[str], n: int) -> set[int]:
    return {_hash(words[i : i + n]) for i in range(len(words) - n + 1)}


def _features(words: list[str]) -> np.ndarray:
    found = {(g * 3 + n) % (1 << BITS) for n in (1, 2, 3) for g in grams(words, n)}
    return np.fromiter(sorted(found), np.int64, len(found))


def _stack(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_features(r) for r in rows]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), sizes


def _is_version(word: str) -> bool:
    return re.fullmatch(r"[0-9]{1,2}(\.[0-9]{1,2})?", word) is not None


@dataclass(frozen=True)
class Template:
    """What a paragraph must contain: trigrams, one of those that end in a version, and for a short form all of the words."""

    family: int
    grams: frozenset[int]
    versions: frozenset[int]
    share: float = MIN_CONTAINED
    whole: tuple[str, ...] = ()

    @staticmethod
    def of(family: int, words: list[str], title: bool) -> Template:
        versions = frozenset(_hash(words[i : i + 3]) for i in range(len(words) - 2) if _is_version(words[i + 2]))
        return Template(family, frozenset(grams(words, 3) or grams(words, len(words))), versions, 1.0 if title else MIN_CONTAINED, tuple(words) if title and len(words) < 4 else ())


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    templates: list[Template]
    #: A family's probability is that of slope * (its score - the score of unknown) + offset.
    slope: float = 1.0
    offset: float = 0.0
    #: The calibration error on held-out templates, by models that have not seen them.
    error: float = 0.0

    def logits(self, rows: list[list[str]]) -> np.ndarray:
        index, sizes = _stack(rows)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), len(self.families)))
        scale = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
        for k in range(len(self.families)):
            out[:, k] = np.bincount(owner, self.weights[index, k] * scale, len(sizes))
        return out + self.bias

    def probabilities(self, rows: list[list[str]]) -> np.ndarray:
        """Of each row and family (without ``unknown``, which is the last)."""
        z = self.logits(rows)
        return _logistic(self.slope * (z[:, :-1] - z[:, -1:]) + self.offset)

    def scan(self, text: str) -> list[tuple[int, str, float, float]]:
        """(paragraph number, family, probability, contained share) of confirmed families."""
        asked = [(number, x) for number, part in enumerate(_parts(text)) for x in (part, *_operands(part))]
        known = [(number, words) for (number, _), words in zip(asked, tokens([x for _, x in asked]), strict=True) if words]
        # Only what has trigrams, or is all, of a template can be confirmed.
        known = [(number, words, own) for number, words in known if (own := self._stated(words)) or tuple(words) in self.short]
        if not known:
            return []
        odds = self.probabilities([words for _, words, _ in known])
        found: dict[tuple[int, str], tuple[float, float]] = {}
        for (number, words, own), p in zip(known, odds, strict=True):
            for family, probability, contained in self._confirmed(words, own, p):
                found.setdefault((number, family), (probability, contained))
        return [(number, family, *values) for (number, family), values in found.items()]

    @cached_property
    def trigrams(self) -> frozenset[int]:
        return frozenset(g for t in self.templates for g in t.grams)

    @cached_property
    def short(self) -> frozenset[tuple[str, ...]]:
        return frozenset(t.whole for t in self.templates if t.whole)

    def _stated(self, words: list[str]) -> set[int]:
        """The template trigrams of a paragraph, without those that are negated."""
        at = [_hash(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = [g in self.trigrams for g in at]
        off = [False] * len(at)
        for i, word in enumerate(words):
            if word in NEGATIONS and not any(hit[max(i - 2, 0) : i + 1]):  # a template's own negation denies nothing
                start = next((j for j in range(i + 1, min(i + 1 + REACH, len(at))) if hit[j]), len(at))
                while start < len(at) and hit[start]:
                    off[start] = True
                    start += 1
        return {g for g, h, o in zip(at, hit, off, strict=True) if h and not o}

    def _confirmed(self, words: list[str], own: set[int], p: np.ndarray) -> list[tuple[str, float, float]]:
        """Families in order of probability; each must have trigrams that those before it do not explain."""
        out, explained = [], set()
        for k in np.argsort(-p, kind="stable").tolist():
            if p[k] < MIN_PROBABILITY:
                break
            shares = []
            for t in (t for t in self.templates if t.family == k):
                if t.whole:
                    shares += [1.0] if t.whole == tuple(words) else []
                    continue
                rest = t.grams - explained
                share = len(own & t.grams) / len(t.grams)
                if rest and share >= t.share and len(own & rest) >= t.share * len(rest) and (not t.versions or own & t.versions):
                    shares.append(share)
            if shares:
                out.append((self.families[k], float(p[k]), max(shares)))
                explained |= {g for t in self.templates if t.family == k for g in t.grams}
        return out


def _parts(text: str) -> list[str]:
    """Each block between blank lines, followed by its lines if it has several."""
    out = []
    for block in re.split(r"\n[ \t\r]*\n", text):
        lines = block.split("\n")
        out.append(block)
        if len(lines) > 1:
            out.extend(lines)
    return out


def _operands(part: str) -> list[str]:
    """The identifiers of each SPDX expression with several, each as a statement of its own."""
    out = []
    for expression in re.findall(SPDX, part):
        names = [x for x in re.split(r"[\s()]+", expression) if x and x.upper() not in ("AND", "OR", "WITH")]
        out += [f"SPDX-License-Identifier: {x}" for x in names if len(names) > 1]
    return out


def paragraphs(text: str) -> list[list[str]]:
    """The words of each block between blank lines, each followed by its lines if it has several."""
    return tokens(_parts(text))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _damaged(words: list[str], filler: list[str], kind: int) -> list[str]:
    """A copy with words dropped, added around, or both, by rule."""
    out = list(words)
    if kind % 3 == 1 and len(out) > 8:
        out = [w for i, w in enumerate(out) if (i + kind) % 9]
    if kind % 2:
        out = filler[: 3 + kind % 5] + out
    if kind % 5 > 2:
        out = out + filler[-(4 + kind % 7) :]
    return out


def train(negatives: list[str]) -> Model:
    """Fit on the templates and on paragraphs of ``negatives``."""
    families = [*TEMPLATES, UNKNOWN]
    spare = tokens([p for text in negatives for p in text.split("\n")])
    notices = [(k, words, title) for k, f in enumerate(families) for title, texts in ((False, TEMPLATES), (True, TITLES)) for words in tokens(texts.get(f, []))]
    near_misses = tokens(list(NEAR_MISSES))
    known = {g for _, words, _ in notices for g in grams(words, 3)}
    none = [p for p in spare if p and not grams(p, 3) & known][:NEGATIVE_PARAGRAPHS] + near_misses * 5
    fillers = [p for p in none if len(p) >= 12] or [[]]
    rows, labels, fold = [], [], []  # a notice is in one fold with all its copies
    for t, (k, words, title) in enumerate(notices):
        for kind in range(24):
            rows.append(words if title and len(words) < 4 else _damaged(words, fillers[(k * 31 + t * 7 + kind) % len(fillers)], kind))
            labels.append(k)
            fold.append(t % FOLDS)
    second = list(labels)
    long = [(t, k, words) for t, (k, words, _) in enumerate(notices) if len(words) > 3]
    for t, k, words in long:  # two notices of one fold in a paragraph
        for u, other, more in long[t % 7 :: 7]:
            if u % FOLDS == t % FOLDS and other != k:
                rows.append(words + ["and"] + more)
                labels.append(k)
                second.append(other)
                fold.append(t % FOLDS)
    for i, words in enumerate(none):
        rows.append(words)
        labels.append(len(families) - 1)
        second.append(len(families) - 1)
        fold.append(i % FOLDS)
    # Only n-grams of notices and near misses weigh; a row is scaled by all that it has.
    weighed = np.unique(_stack([*(words for _, words, _ in notices), *near_misses])[0])
    index, sizes = _stack(rows)
    owner, at = np.repeat(np.arange(len(rows)), sizes), np.minimum(np.searchsorted(weighed, index), len(weighed) - 1)
    hit = weighed[at] == index
    x = np.zeros((len(rows), len(weighed)), np.float32)
    x[owner[hit], at[hit]] = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)[hit]
    truth, folds = np.array(labels), np.array(fold)
    also = np.array(second)
    target = (np.eye(len(families))[truth] + np.eye(len(families))[also]) / 2

    def fitted(fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = np.bincount(truth[fit], minlength=len(families)).clip(1)
        x_fit, target_fit, weight = x[fit], target[fit], 1 / share[truth[fit]] / len(families)
        weights, bias = np.zeros((len(weighed), len(families)), np.float32), np.zeros(len(families))
        seen = np.full_like(weights, 1e-9)
        for _ in range(STEPS):
            slope = (_softmax(x_fit @ weights + bias) - target_fit) * weight[:, None]
            gradient = x_fit.T @ slope.astype(np.float32) + np.float32(1e-6) * weights
            seen += gradient**2
            weights -= np.float32(0.2) * gradient / np.sqrt(seen)
            bias -= slope.sum(axis=0)
        return weights, bias

    # Of each row the best family; of a row with two, both of those.
    margin, right = np.zeros((len(rows), 2)), np.zeros((len(rows), 2), bool)
    for f in range(FOLDS):
        out = folds == f
        weights, bias = fitted(~out)
        z = x[out] @ weights + bias
        best = np.argsort(-z[:, :-1], axis=1, kind="stable")[:, :2]
        best[:, 1] = np.where(truth[out] == also[out], best[:, 0], best[:, 1])
        margin[out] = np.take_along_axis(z, best, axis=1) - z[:, -1:]
        right[out] = (best == truth[out, None]) | (best == also[out, None])
    # Notices and other paragraphs weigh alike, as they do not in the corpus, whose share of notices is not known here.
    is_none = truth == len(families) - 1
    even = np.where(is_none, 1 / max(is_none.sum(), 1), 1 / max((~is_none).sum(), 1))
    margins, rights, share = margin.ravel(), right.ravel(), np.repeat(even / even.sum() / 2, 2)
    slope, offset = _calibrated(margins, rights, share)
    error = _calibration_error(_logistic(slope * margins + offset), rights, share)
    weights, bias = fitted(np.ones(len(rows), bool))
    whole = np.zeros((1 << BITS, len(families)))
    whole[weighed] = weights
    return Model(families, whole, bias, [Template.of(*n) for n in notices], slope, offset, error)


def _calibrated(margin: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function that fits best, by Newton's method."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = _logistic(x @ at)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        at -= np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - right)) + 1e-6 * at), -1, 1)
    return float(at[0]), float(at[1])


def _calibration_error(p: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """The mean difference of probability and share of right answers over ten ranges of probability."""
    bins = np.minimum((p * 10).astype(int), 9)
    return float(sum(abs((weight * (p - right))[bins == b].sum()) for b in range(10)))


def _text_grams(texts: pa.Array, sizes: tuple[int, ...] = (3,)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of the texts, for each n of ``sizes``, and the text of each."""
    words, counts = text_arrays.word_hashes(plain(texts), lower=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.uint64(0x9E3779B97F4A7C15)
    codes, owners = [], []
    for n in sizes:
        end = max(len(words) - n + 1, 0)
        code = np.zeros(end, np.uint64)
        for i in range(n):
            code = code * step + words[i : i + end]
        same = owner[:end] == owner[n - 1 : n - 1 + end]
        codes.append(text_arrays.mix(code[same]))
        owners.append(owner[:end][same])
    return np.concatenate(codes), np.concatenate(owners)


def _families(found: set[str]) -> list[str]:
    return sorted(found - {HOLDS[x] for x in found if x in HOLDS})


def sample_negatives(docs: DataFrame, text: str = "text") -> list[str]:
    """At most NEGATIVES texts of at most SAMPLE_BYTES bytes, by hash."""
    rows = first_by_hash(docs.select(F.col(text).alias("text")).where(fits("text")), NEGATIVES, "text")
    return [r["text"] for r in rows.collect()]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses (sorted, distinct families) and findings (paragraph, family, probability, contained)."""
    model = train(sample_negatives(docs, text))
    template_texts = pa.array([t for texts in (TEMPLATES, TITLES) for rows in texts.values() for t in rows])
    short = pa.array([t for t, words in zip(template_texts.to_pylist(), tokens(template_texts.to_pylist()), strict=True) if len(words) < 3])
    known = np.unique(np.concatenate([_text_grams(template_texts)[0], _text_grams(short, (2,))[0]]))
    shared = docs.sparkSession.sparkContext.broadcast((model, known))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, codes = shared.value
        for batch in batches:
            for part in text_arrays.slices(batch, "text"):
                trigrams, owner = _text_grams(part.column("text"), (2, 3))
                at = np.searchsorted(codes, trigrams)
                hit = codes[np.minimum(at, len(codes) - 1)] == trigrams
                found: list[list[dict[str, object]]] = [[] for _ in range(part.num_rows)]
                for i in np.unique(owner[hit]).tolist():
                    found[i] = [dict(zip(("paragraph", "family", "probability", "contained"), x, strict=True)) for x in m.scan(part.column("text")[i].as_py())]
                names = [_families({x["family"] for x in f}) for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], names=["doc_id", "licenses", "findings"])

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, licenses array<string>, findings array<struct<paragraph: int, family: string, probability: double, contained: double>>"
    return slim.mapInArrow(run, schema)
