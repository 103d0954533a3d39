"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Seven labellers vote good, bad or nothing on each document. Documents are counted by their votes
(at most 3^7 = 2,187 rows, whatever the input), and expectation-maximisation on these counts
estimates the prior and, for each labeller and class, how often it votes what; no labels are read.
The posterior of a document's votes is its weak label. A logistic scorer over hashed byte trigrams,
word hashes and repeated neighbours learns the weak labels of a sample, and scores all documents.

The counts cover all documents. The scorer is fitted on at most TRAIN_DOCS documents of at most
SAMPLE_BYTES bytes, taken by hash of their id, and only features that occur in them take part in its
steps. Scoring is per row and shuffles nothing; the broadcast weights have a fixed size.

Defined results: a null or empty text, or one without a word, gets score 0 and is not kept. Repeated
rows get equal results; null ids are allowed. Other columns are ignored. With no document to learn
from, scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import text_arrays
from skein.llm.common import WORD, let
from skein.llm.sampling import first_by_hash, fits

TRAIN_DOCS = 2000
ROUNDS = 60
STEPS = 100
TRIGRAM_BITS = 16
WORD_BITS = 18
KEEP_AT = 0.5
GOOD, BAD, NONE = 1, 0, -1

#: Frequent function words of the four languages, for the labeller ``function_words``.
FUNCTION_WORDS = "the of and to in is that for on with der die und das von zu mit den ist im de la le les et des en du un une el los que y las por".split()


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def votes(text: Column, words: Column) -> dict[str, Column]:
    """The labellers' votes; ``words`` is the list of words of ``text``."""
    n = F.size(words)
    letters = F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.lit(1))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}!", ""))
    distinct = F.size(F.array_distinct(words))
    # Herdan's measure of lexical variety hardly depends on the length of a text.
    variety = F.when(n > 1, F.log(distinct) / F.log(n))
    repeats = let(words, lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))))
    function = F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS)))
    ends = F.regexp_count(text, F.lit(r"[.?!](?=\s|$)"))
    return {
        "length": _vote(n < 5, n >= 60),
        "symbols": _vote(symbols > 0.15 * n, symbols < 0.03 * n),
        "capitals": _vote(capitals > 0.3 * letters, capitals < 0.12 * letters),
        "neighbours": _vote(repeats > 0.1 * n, repeats < 0.02 * n),
        "variety": _vote(variety < 0.8, variety > 0.85),
        "function_words": _vote(function < 0.05 * n, function > 0.12 * n),
        "sentences": _vote(ends < n / 60, ends.between(n / 25, n / 3)),
    }


LABELLERS = ("length", "symbols", "capitals", "neighbours", "variety", "function_words", "sentences")


def vote_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_v_<labeller>`` for each labeller."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_vwords", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    return df.select(*docs.columns, *(v.alias(f"_v_{k}") for k, v in votes(body, F.col("_vwords")).items()))


@dataclass
class LabelModel:
    """Prior of good, and P(vote | class) as an array of labeller, class (bad, good), vote (bad, good, none)."""

    prior: float
    rates: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        at = np.where(table < 0, 2, table)
        logs = np.log(self.rates)
        score = [sum(logs[j, c, at[:, j]] for j in range(table.shape[1])) for c in (0, 1)]
        gap = score[1] - score[0] + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller: share of right votes among its votes."""
        right = (1 - self.prior) * self.rates[:, 0, 0] + self.prior * self.rates[:, 1, 1]
        wrong = (1 - self.prior) * self.rates[:, 0, 1] + self.prior * self.rates[:, 1, 0]
        return right / (right + wrong)


def expectation_maximisation(table: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """From rows of votes and how many documents have them; starts from the vote of the majority."""
    good, bad = (table == GOOD).sum(axis=1), (table == BAD).sum(axis=1)
    belief = (good + 1) / (good + 2.0 * bad + 2)  # one bad vote weighs as two good ones
    at = np.where(table < 0, 2, table)
    model = LabelModel(0.5, np.full((table.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - belief), counts * belief])
        rates = np.stack([[np.bincount(at[:, j], mass[c], 3) + 1.0 for c in (0, 1)] for j in range(table.shape[1])])
        model = LabelModel(float(np.clip(mass[1].sum() / mass.sum(), 0.02, 0.98)), rates / rates.sum(axis=2, keepdims=True))
        belief = model.posterior(table)
    return model


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all texts, and the number of them per text."""
    raw, at = text_arrays.raw_bytes(texts)
    padded = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.uint32)
    second, third = padded[1:-1].copy(), padded[2:].copy()
    ends = at[1:][np.diff(at) > 0]
    second[ends - 1], third[ends - 1] = 0, 0  # no trigram goes on in the next text
    third[np.maximum(ends - 2, 0)] = 0
    code = padded[:-2] | (second << 8) | (third << 16)
    trigram = ((code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)
    words, counts = text_arrays.word_hashes(texts, lower=False)
    word = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << TRIGRAM_BITS)
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    last = (1 << TRIGRAM_BITS) + (1 << WORD_BITS)
    word[again] = last
    n_raw = np.diff(at)
    sizes = n_raw + counts
    out = np.empty(sizes.sum(), np.int64)
    begins = np.cumsum(sizes) - sizes
    out[np.arange(len(raw)) + np.repeat(begins - at[:-1], n_raw)] = trigram
    out[np.arange(len(words)) + np.repeat(begins + n_raw - np.cumsum(counts) + counts, counts)] = word
    return out, sizes


N_FEATURES = (1 << TRIGRAM_BITS) + (1 << WORD_BITS) + 1


def _sums(weights: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean weight of each text's features; 0 without one."""
    out = np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(weights[index], (np.cumsum(sizes) - sizes)[full]) / sizes[full]
    return out


def train(texts: list[str], target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft labels, by adaptive gradient steps."""
    weights, bias = np.zeros(N_FEATURES), 0.0
    if not texts:
        return weights, bias
    index, sizes = _features(pa.array(texts, pa.large_string()))
    per = np.repeat(1.0 / np.maximum(sizes, 1), sizes)
    classes = np.where(target > 0.5, 1 / max(target.sum(), 1), 1 / max((1 - target).sum(), 1))
    classes = classes / classes.sum()
    known, index = np.unique(index, return_inverse=True)
    step = np.zeros(len(known))
    bound, seen, seen_bias = 1.0, np.full(len(known), 1e-12), 1e-12
    for _ in range(steps):
        odds = 1 / (1 + np.exp(-np.clip(_sums(step, index, sizes) + bias, -40, 40)))
        slope = (odds - target) * classes
        gradient = np.bincount(index, np.repeat(slope, sizes) * per, len(known)) + 1e-7 * step
        seen += gradient**2
        seen_bias += slope.sum() ** 2
        step -= bound * gradient / np.sqrt(seen)
        bias -= 0.1 * bound * slope.sum() / np.sqrt(seen_bias)
    weights[known] = step
    return weights, float(bias)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT, train_docs: int = TRAIN_DOCS, weak_labels: bool = False) -> DataFrame:
    """doc_id, score and keep (score of ``keep_at`` or more), and if so asked ``weak_label``.

    The weak label is the posterior of the document's votes; it costs to vote again.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [f"_v_{x}" for x in LABELLERS]
    counted = vote_table(slim.select("text")).groupBy(*names).count().collect()  # 3^7 rows at most
    table = np.array([[r[c] for c in names] for r in counted], np.int64).reshape(-1, len(names))
    labels = expectation_maximisation(table, np.array([r["count"] for r in counted], float)) if counted else LabelModel(0.5, np.full((len(names), 2, 3), 1 / 3))
    first = first_by_hash(slim.where(F.col("text").rlike(WORD) & fits("text")), train_docs, "doc_id", "text")
    sample = vote_table(first.select("text")).collect()
    target = labels.posterior(np.array([[r[c] for c in names] for r in sample], np.int64)) if sample else np.zeros(0)
    weights, bias = train([r["text"] for r in sample], target)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for part in text_arrays.slices(batch, "text"):
                index, sizes = _features(part.column("text"))
                odds = 1 / (1 + np.exp(-np.clip(_sums(w, index, sizes) + b, -40, 40)))
                _, words = text_arrays.word_hashes(part.column("text"))
                odds[words == 0] = 0.0
                passed = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(odds)], names=[*passed, "score"])

    voted = vote_table(slim) if weak_labels else slim
    passed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voted.schema.fields if f.name != "text")
    scored = voted.mapInArrow(run, f"{passed}, score double")
    keep = (F.col("score") >= keep_at).alias("keep")
    if not weak_labels:
        return scored.select("doc_id", "score", keep)
    gap = F.lit(float(np.log(labels.prior) - np.log(1 - labels.prior)))
    logs = np.log(labels.rates)
    for j, name in enumerate(names):
        steps = (logs[j, 1] - logs[j, 0]).tolist()
        gap = gap + F.when(F.col(name) == BAD, steps[0]).when(F.col(name) == GOOD, steps[1]).otherwise(steps[2])
    weak = F.when(F.col("score") == 0, 0.0).otherwise(1 / (1 + F.exp(-gap)))
    return scored.select("doc_id", "score", keep, weak.alias("weak_label"))
