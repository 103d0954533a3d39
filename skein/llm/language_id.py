"""Language identification by a string kernel.

The kernel counts the letter n-grams (n = 1 to 3, in lower case, words bounded by one mark) that two
texts both have, whatever their frequency, normalised by the texts' own counts. A sample of labelled
texts is fitted by one-versus-rest kernel ridge regression on Nystroem landmarks: with the landmark
kernel ``K_mm`` and the kernel ``K_nm`` between sample and landmarks, the coefficients solve
``(K_nm' K_nm + n * ridge * K_mm) a = K_nm' y``. Only n-grams of landmarks count. An inverted list says which
landmarks have an n-gram, so a text's kernels with all landmarks are counts of what its own n-grams list;
the kernels of a batch are stacked and scored by one matrix product with the coefficients.

Fitting is bounded and documented: at most PER_LANGUAGE texts of each of MOST_LANGUAGES languages and
MOST_TEXTS in all, of at most SAMPLE_BYTES bytes each, taken by hash of their id. LANDMARKS of them, or
one of each language if there are more languages, are landmarks; all their letters count, of whatever
script. Languages are counted first, so that little more than the sample is shuffled. Prediction covers all texts, whole, and shuffles nothing.
The broadcast model is the landmarks' n-grams (a table of 24 to 48 bytes each, of at most three for each letter of
LANDMARKS texts or one a language), the inverted list (two bytes an n-gram of a landmark) and landmarks x languages coefficients.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing can be learned from. A null language teaches nothing. Repeated rows get equal results. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import text_arrays
from skein.llm.sampling import SPAN, fits, place

PER_LANGUAGE = 400
MOST_TEXTS = 8000
MOST_LANGUAGES = 1000
LANDMARKS = 256
RIDGE = 1e-3
ROWS = 128
#: Bytes of the presence rows that are made at once, and entries of the inverted list that are counted at once.
CELLS = 1 << 23
LISTED = 1 << 20
UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@dataclass
class Grams:
    """Numbers of letters (0: none, 1: one that no landmark has, from 2 on those of landmarks), and the
    landmarks' n-grams with their ids in an open hash table."""

    letter: np.ndarray
    base: int
    slots: np.ndarray
    ids: np.ndarray
    size: int

    @classmethod
    def learn(cls, landmarks: list[str]) -> Grams:
        points = np.unique(np.frombuffer("".join(landmarks).lower().encode("utf-32-le"), np.uint32))
        points = points[_is_letter()[points]]
        letter = _is_letter().astype(np.int32)
        letter[points] = np.arange(2, 2 + len(points))
        out = cls(letter, 2 + len(points), np.zeros(1, np.int64), np.zeros(1, np.int32), 0)
        codes = np.unique(np.concatenate([out._codes(pa.array([x]))[1] for x in landmarks]))
        out.size = len(codes)
        out.slots = np.zeros(1 << (2 * len(codes)).bit_length(), np.int64)  # no n-gram has the code 0
        out.ids = np.full(len(out.slots), -1, np.int32)
        left = np.arange(len(codes))
        at = out._slot(codes)
        while len(left):
            free = out.slots[at] == 0
            spot, first = np.unique(at[free], return_index=True)
            out.slots[spot], out.ids[spot] = codes[left[free][first]], left[free][first]
            rest = out.slots[at] != codes[left]
            left, at = left[rest], (at[rest] + 1) & (len(out.slots) - 1)
        return out

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and code of every n-gram occurrence."""
        lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False) + 2
        joined = "".join(f"\n{t}\n" for t in lower.to_pylist())
        symbol = self.letter[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        keep = symbol > 0
        keep[1:] |= (symbol[:-1] > 0) | (owner[1:] != owner[:-1])
        keep[:1] = True
        symbol, owner = symbol[keep].astype(np.int64), owner[keep]
        one, two = self.base, self.base**2
        pair = symbol[:-1] * one + symbol[1:]
        same = owner[:-1] == owner[1:]
        triple = pair[:-1] * one + symbol[2:]
        whole = same[:-1] & same[1:]
        single = symbol > 0
        owners = np.concatenate([owner[single], owner[:-1][same], owner[:-2][whole]])
        return owners, np.concatenate([symbol[single], one + pair[same], one + two + triple[whole]])

    def _look_up(self, codes: np.ndarray) -> np.ndarray:
        """The id of each code, or -1."""
        out = np.full(len(codes), -1, np.int32)
        at, rest = self._slot(codes), np.arange(len(codes))
        while len(rest):
            held = self.slots[at]
            hit = held == codes
            out[rest[hit]] = self.ids[at[hit]]
            more = ~hit & (held != 0)
            rest, codes, at = rest[more], codes[more], (at[more] + 1) & (len(self.slots) - 1)
        return out

    def presence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and id of every one of the landmarks' n-grams that a text has, once, in order."""
        owners, codes = self._codes(texts)
        ids = self._look_up(codes)
        known = ids >= 0
        rows = np.zeros(len(texts) * self.size, bool)
        rows[owners[known].astype(np.int64) * self.size + ids[known]] = True
        return np.divmod(np.flatnonzero(rows), self.size)

    def rows_at_once(self) -> int:
        return max(1, min(ROWS, CELLS // max(1, self.size)))

    def has_letter(self, texts: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


@dataclass
class Landmarks:
    """Which landmarks have an n-gram: those of id i stand in ``held`` from ``begin[i]`` to ``begin[i + 1]``."""

    grams: Grams
    begin: np.ndarray
    held: np.ndarray
    norm: np.ndarray

    @classmethod
    def learn(cls, texts: list[str]) -> Landmarks:
        grams = Grams.learn(texts)
        owners, ids = [], []
        for start in range(0, len(texts), grams.rows_at_once()):
            own, found = grams.presence(pa.array(texts[start : start + grams.rows_at_once()]))
            owners.append((own + start).astype(np.uint16))
            ids.append(found.astype(np.int32))
        owner, number = np.concatenate(owners), np.concatenate(ids)
        norm = np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))
        begin = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=grams.size))])
        return cls(grams, begin, owner[np.argsort(number, kind="stable")], norm)

    def kernel(self, texts: pa.Array) -> np.ndarray:
        """Of each text with each landmark, for as many texts as ``rows_at_once`` says."""
        owner, number = self.grams.presence(texts)
        n, m = len(texts), len(self.norm)
        long = self.begin[number + 1] - self.begin[number]
        ends = np.cumsum(long)
        shared = np.zeros(n * m, np.int64)
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), LISTED)), len(ends))) if len(ends) else [0]
        for a, b in itertools.pairwise(edges):
            some = long[a:b]
            at = np.arange(some.sum()) + np.repeat(self.begin[number[a:b]] - np.cumsum(some) + some, some)
            shared += np.bincount(np.repeat(owner[a:b] * m, some) + self.held[at], minlength=n * m)
        own = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        return shared.reshape(n, m) / own[:, None] / self.norm[None, :]

    def kernels(self, texts: list[str]) -> np.ndarray:
        step = self.grams.rows_at_once()
        return np.concatenate([self.kernel(pa.array(texts[i : i + step])) for i in range(0, len(texts), step)])


@dataclass
class Model:
    """A text's kernels with the landmarks times ``solved``, plus ``offset``, are its scores."""

    languages: list[str]
    marks: Landmarks | None
    solved: np.ndarray
    offset: np.ndarray
    sharpness: float

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.solved + self.offset

    def probabilities(self, kernel: np.ndarray) -> np.ndarray:
        scores = self.scores(kernel) * self.sharpness
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit_rows(texts: list[str], labels: list[str]) -> Model:
    """Fit from texts that have a letter; the first LANDMARKS, dealt evenly to languages, are landmarks, one of each at least."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], None, np.zeros((0, 0)), np.zeros(0), 1.0)
    at: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        at.setdefault(label, []).append(i)
    share = max(1, LANDMARKS // len(languages))
    chosen = [i for x in languages for i in at[x][:share]]
    marks = Landmarks.learn([texts[i] for i in chosen])
    k_nm = marks.kernels(texts)
    k_mm = k_nm[chosen]
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    offset = target.mean(axis=0)
    left = k_nm.T @ k_nm + len(texts) * RIDGE * k_mm + 1e-8 * np.eye(len(chosen))
    model = Model(languages, marks, np.linalg.solve(left, k_nm.T @ (target - offset)), offset, 1.0)
    truth = target.argmax(axis=1)
    scored = k_nm @ model.solved + offset

    def loss(sharpness: float) -> float:
        z = scored * sharpness
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    model.sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0), key=loss)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the documents that are not held out."""
    known = docs.where(~is_held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & fits(F.col(text)))
    sample = known.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = sample.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(MOST_LANGUAGES)
    below = counts.select("lang", (F.least(F.lit(1.0), (2 * PER_LANGUAGE + 100) / F.col("_n")) * SPAN).cast("long").alias("_below"))
    # A row per language, at most MOST_LANGUAGES, is broadcast; of the texts about twice as many as
    # are wanted leave their tasks, so no task meets a whole language.
    few = sample.withColumn("_place", place("doc_id")).join(F.broadcast(below), "lang").where(F.col("_place") < F.col("_below"))
    order = Window.partitionBy("lang").orderBy("_place", "doc_id", "text")
    rows = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE).orderBy("rank", "lang").limit(MOST_TEXTS).collect()
    return fit_rows([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for some in text_arrays.slices(batch, "text"):
                at_once = m.marks.grams.rows_at_once() if m.marks is not None else ROWS
                for start in range(0, some.num_rows, at_once):
                    part = some.slice(start, at_once)
                    texts = part.column("text")
                    best, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                    if m.marks is not None:
                        fine = m.marks.grams.has_letter(texts)
                        odds = m.probabilities(m.marks.kernel(texts))
                        best = np.where(fine, odds.argmax(axis=1), best)
                        score = np.where(fine, odds.max(axis=1), 0.0).astype(float)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
