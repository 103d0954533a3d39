"""Words of texts in Thai, which is written without spaces, by maximal matching against a dictionary.

A run of Thai letters becomes dictionary words and unknown pieces: as few unknown letters as can be, then as few
tokens, then the longest word first. That is a shortest path over the run's letters, found from right to
left in one pass over a table of the dictionary's prefixes. No piece begins with a combining mark. In a text with Thai
all other words have one letter or more; texts without Thai have the words that ``text.tokens`` finds, and
stay in the JVM.

The dictionary is an argument, and broadcast; it has at most MOST_WORDS words, or an error is raised.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx

MOST_WORDS = 500_000
#: Thai letters and marks, without digits, which are folded.
THAI = "฀-๏๚-๿"
PIECES = re.compile(rf"[{THAI}]+|[^\W{THAI}]+")
RUNS = 1 << 16


def prefixes(words: Iterable[str]) -> dict[str, bool]:
    """Every prefix of the words, and whether it is a word itself."""
    table: dict[str, bool] = {}
    for word in words:
        for n in range(1, len(word)):
            table.setdefault(word[:n], False)
        if word:
            table[word] = True
    return table


def segment(run: str, table: dict[str, bool]) -> list[str]:
    """The tokens of one run."""
    n = len(run)
    starts = [i == n or not unicodedata.category(run[i]).startswith("M") or i == 0 for i in range(n + 1)]
    # Costs (unknown letters, tokens) of the rest after a whole token, and within an unknown piece; where each goes on.
    whole: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    inside = list(whole)
    word_to, whole_to, inside_to = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        best, to = (n + 1, 0), 0
        j = i + 1
        while starts[i] and j <= n and (is_word := table.get(run[i:j])) is not None:
            if is_word and starts[j]:
                cost = (whole[j][0], whole[j][1] + 1)
                if cost <= best:  # the longest of equal ones
                    best, to = cost, j
            j += 1
        word_to[i] = to
        new = (inside[i + 1][0] + 1, inside[i + 1][1] + 1)
        more = (inside[i + 1][0] + 1, inside[i + 1][1])
        whole[i], whole_to[i] = (best, to) if to and best <= new else (new, 0)
        inside[i], inside_to[i] = (best, to) if to and best <= more else (more, 0)
    out, i, unknown = [], 0, False
    while i < n:
        to = inside_to[i] if unknown else whole_to[i]
        if to:
            out.append(run[i:to])
            i, unknown = to, False
        else:
            if unknown:
                out[-1] += run[i]
            else:
                out.append(run[i])
            i, unknown = i + 1, True
    return out


def words(text: str, table: dict[str, bool], cut: Callable[[str], list[str]] | None = None) -> list[str]:
    """The words of a folded text with Thai in it: those of Thai runs that have a letter, and all others."""
    cut = cut or (lambda run: segment(run, table))
    out = []
    for piece in PIECES.findall(text):
        found = cut(piece) if re.match(rf"[{THAI}]", piece) else [piece]
        out += [w for w in found if any(c.isalnum() for c in w)]
    return out


def segmenter(spark: SparkSession, dictionary: DataFrame | list[str]) -> Callable[[Column], Column]:
    """A function from texts to arrays of words, for a dictionary (word)."""
    if isinstance(dictionary, DataFrame):
        dictionary = [r[0] for r in dictionary.select(tx.fold(F.col(dictionary.columns[0]))).where(F.col(dictionary.columns[0]).isNotNull()).distinct().limit(MOST_WORDS + 1).collect()]
    if len(dictionary) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS:,} words")
    shared = spark.sparkContext.broadcast(prefixes(dictionary))

    def run(texts: pd.Series) -> pd.Series:
        cut = functools.lru_cache(RUNS)(lambda piece: segment(piece, shared.value))
        return texts.map(lambda t: None if t is None else words(t, shared.value, cut))

    split = F.pandas_udf(run, "array<string>")  # type: ignore[call-overload]

    def tokens(text: Column) -> Column:
        has = text.rlike(f"[{THAI}]")
        return F.when(has, split(F.when(has, tx.fold(text)))).otherwise(tx.tokens(text))

    return tokens
