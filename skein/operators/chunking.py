"""Passages from pages and sections from notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as tx
from skein.plans.lineage import cut

WORDS, OVERLAP = 260, 40
SECTION_WORDS = 200
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_TOKEN = re.compile(r"(?u)\b\w\w+\b")


def windows(pages: DataFrame, keys: list[str], text: str = "text", words: int = WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Keys, ``start`` (first word from 0), ``n_words`` and ``text`` of overlapping word windows.

    The last window is the first that reaches the end; a page without words has none.
    """
    step = max(1, words - overlap)
    listed = pages.select(*keys, tx.whitespace_words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    last = F.when(F.size("_words") <= words, 0).otherwise(F.ceil((F.size("_words") - words) / step) * step).cast("int")
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = listed.select(*keys, "_words", F.explode(starts).alias("start"))
    part = F.slice("_words", F.col("start") + 1, words)
    return rows.select(*keys, "start", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


def numbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    """``chunks`` with dense ids from 0 in the given order.

    Rows are dealt into ranges, once, and kept in the checkpoint folder, since another sampling could
    deal them otherwise. A range's offset is the number of rows before it, so that no task sees more
    than one range.
    """
    ordered = cut(chunks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ordered = ordered.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ordered.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def drop_repeats(pages: DataFrame, key: str, text: str = "text", min_chars: int = 40) -> DataFrame:
    """(key, text, looped): pages without sentences of ``min_chars`` that the page had before.

    Lines that lose all sentences go; empty lines stay. A page is one row and is worked on within it, so nothing
    is shuffled: its sentences are sorted by form, marked, and sorted back into their order.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r")

    def of_line(line: Column, i: Column) -> Column:
        return F.transform(tx.sentences(line), lambda x: F.struct(i.alias("line_no"), x.alias("sentence"), F.lower(tx.collapse(x)).alias("form")))

    parts = pages.select(F.col(key).alias("key"), F.flatten(F.transform(lines, of_line)).alias("parts"))
    by_form = F.array_sort(F.transform("parts", lambda x, i: F.struct(F.when(F.length(x["form"]) >= min_chars, x["form"]).alias("form"), i.alias("place"), x["line_no"].alias("line_no"), x["sentence"].alias("sentence"), (x["form"] == "").alias("blank"))))
    parts = parts.select("key", by_form.alias("parts"))

    def marked(x: Column, i: Column) -> Column:
        again = F.coalesce(x["form"] == F.get("parts", i - 1)["form"], F.lit(False))
        return F.struct(x["place"].alias("place"), x["line_no"].alias("line_no"), x["sentence"].alias("sentence"), again.alias("again"), x["blank"].alias("blank"))

    parts = parts.select("key", F.array_sort(F.transform("parts", marked)).alias("parts"))
    parts = parts.select("key", F.exists("parts", lambda x: x["again"]).alias("looped"), F.filter("parts", lambda x: ~x["again"] | x["blank"]).alias("kept"))

    def joined(x: Column, i: Column) -> Column:
        gap = F.when(i == 0, "").when(x["line_no"] == F.get("kept", i - 1)["line_no"], " ").otherwise("\n")
        return F.concat(gap, x["sentence"])

    whole = F.array_join(F.transform("kept", joined), "")
    # White space at the ends of lines; a run is tried once, from its beginning.
    ended = F.regexp_replace(whole, r"(?<![ \t\x0B\f])[ \t\x0B\f]+(?=\n|\z)", "")
    return parts.select("key", ended.alias("text"), "looped")


def _sections(text: str) -> list[tuple[str, int, list[str]]]:
    """(heading path, line number, lines): headings inside fences are text, front matter is left out."""
    lines = text.split("\n")
    start = 0
    if lines[0].strip() == "---":
        closing = [i for i, line in enumerate(lines[1:], 1) if line.strip() in ("---", "...")]
        start = closing[0] + 1 if closing else 0
    found: list[tuple[str, int, list[str]]] = [("", start + 1, [])]
    titles: dict[int, str] = {}
    fence = ""
    for number, line in enumerate(lines[start:], start + 1):
        if mark := _FENCE.match(line):
            char = mark[1][0]
            fence = char if not fence else "" if char == fence else fence
        title = None if fence else _HEADING.match(line)
        if title:
            level = len(title[1])
            titles = {k: v for k, v in titles.items() if k < level} | {level: title[2]}
            found.append((" > ".join(titles[k] for k in sorted(titles)), number, [line]))
        else:
            found[-1][2].append(line)
    return found


def _paragraphs(first: int, lines: list[str]) -> Iterator[tuple[int, str]]:
    block: list[str] = []
    for offset, line in enumerate([*lines, ""]):
        if line.strip():
            block.append(line)
        elif block:
            yield first + offset - len(block), "\n".join(block).strip()
            block = []


def markdown_chunks(text: str, max_words: int = SECTION_WORDS) -> list[dict[str, object]]:
    """Sections of a note: heading, ord, line and text; long ones are packed paragraph by paragraph."""
    count = lambda s: len(_TOKEN.findall(s.lower()))
    out: list[dict[str, object]] = []
    for heading, first, lines in _sections(text):
        body = "\n".join(lines).strip()
        if not body:
            continue
        blank = next(i for i, line in enumerate(lines) if line.strip())
        packed: list[list[tuple[int, str]]] = [[(first + blank, body)]]
        if count(body) > max_words:
            packed, total = [], 0
            for line, paragraph in _paragraphs(first, lines):
                size = count(paragraph)
                if not packed or total + size > max_words:
                    packed.append([])
                    total = 0
                packed[-1].append((line, paragraph))
                total += size
        out.extend({"heading": heading, "ord": len(out) + i, "line": group[0][0], "text": "\n\n".join(p for _, p in group)} for i, group in enumerate(packed))
    return out


def sections(notes: DataFrame, path: str = "path", text: str = "text", max_words: int = SECTION_WORDS) -> DataFrame:
    """(id, path, heading, ord, line, text, key) of notes; sections that repeat in a note count once.

    Of equal sections the fields of the last stay, as an upsert by id leaves them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p, **chunk} for p, t in zip(frame["path"], frame["text"], strict=True) for chunk in markdown_chunks(t or "", max_words)]
            yield pd.DataFrame(rows, columns=["path", "heading", "ord", "line", "text"])

    rows = notes.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, heading string, ord int, line int, text string")
    rows = rows.withColumn("id", tx.chunk_id(F.col("path"), F.col("heading"), F.col("text")))
    last = rows.groupBy("id").agg(F.max_by(F.struct("path", "heading", "ord", "line", "text"), "ord").alias("row")).select("id", "row.*")
    return last.withColumn("key", tx.section_key(F.col("heading"), F.col("text")))


def greedy_batches(rows: DataFrame, size: str, limit: int, order: list[str], group: list[str]) -> DataFrame:
    """``rows`` with ``batch``: consecutive rows of a group share one until the next would pass ``limit``.

    Where a batch begins depends on all rows before, so the rows of a group stream through one task in
    order, sorted by Spark and never held; ties are ordered by all other columns. A null size counts as 0.
    """
    others = [c for c in rows.columns if c not in (*group, *order, size)]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, *order, size, *others)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, total = None, 0, 0
        for part in parts:
            keys = zip(*(part.column(c).to_pylist() for c in group), strict=True)
            numbers = []
            for key, n in zip(keys, part.column(size).to_pylist(), strict=True):
                n = n or 0
                if key != last:
                    last, batch, total = key, 0, 0
                if total > 0 and total + n > limit:
                    batch, total = batch + 1, 0
                total += n
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int32())], names=[*part.schema.names, "batch"])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("batch", T.IntegerType())])
    return dealt.mapInArrow(run, schema)
