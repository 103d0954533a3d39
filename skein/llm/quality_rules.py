"""Quality rules: base rules on each document, and line frequency across documents.

Lines are normalised and hashed, and each host's distinct documents with a line are counted. A line
in more than ``min_docs`` of them is boilerplate if it is also in more than ``max_share`` of the
host's documents or in more than ``max_docs``, so that what a large host leaves in has a bound: the
line is removed, and a document left with too few of its words is rejected. Only built-in functions run.

Plan: text is never shuffled to obtain verdicts. It is read twice: for the base measures, and for a
slim table of lines (hashes and numbers of words) in the checkpoint folder, from which lines are
counted and marked. Counting sends (host, line hash, text hash) once with partial aggregation, so a
line or host that a third of all rows share is spread by its text hash; the join that marks lines has
one row per line on its other side, so that adaptive execution can split a hot key.

Defined results: a null or empty text has no words, fails the base rules and is rejected. A null
host is a host of its own. Documents with equal texts count once per host, so copies and repeated
rows never make a line frequent; each row gets its own result. Other columns are carried through by
``clean`` and ignored by ``judge``; helper columns start with ``_q``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE, WORD, cut, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MIN_DOCS = 10
MAX_SHARE = 0.1
MAX_DOCS = 100
MIN_KEPT_SHARE = 0.3


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    """Hash of a line without regard to case, digits and the amount of white space."""
    plain = F.regexp_replace(F.lower(line), SPACE, " ")
    return F.xxhash64(F.trim(F.regexp_replace(plain, "[0-9]+", "0")))


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more; windows are hashes in text order."""

    def adjacent(ordered: Column) -> Column:
        same = lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def union(starts: Column) -> Column:
        state = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(5), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, state, step, lambda s: s["n"])

    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(ordered, adjacent), union)


def repeated_words(word_list: Column) -> Column:
    """Words in five-word windows that are found twice or more in the text, the first included."""

    def windows(hashes: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(5)))
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), at)

    count = lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_covered(h))
    return F.when(F.size(word_list) < 6, F.lit(0)).otherwise(let(let(F.transform(word_list, lambda w: F.xxhash64(w)), windows), count))


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and the verdict of the base rules."""
    body = _text(text)
    df = docs.withColumn("_qwords", words(body)).withColumn("_qlines", lines(body))
    out = df.select(
        *docs.columns,
        F.size("_qwords").cast("long").alias("n_words"),
        F.length(F.array_join("_qwords", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_qlines") - F.size(F.array_distinct("_qlines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_qwords")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(_qid, _qhost, _qtext, _qpos, _qkey, _qn): the lines of each document, or one row of nulls, with their words."""
    items = F.transform(lines(_text(text)), lambda x: F.struct(line_key(x).alias("k"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    # Outer: documents without a line count as documents, and lines are not found twice to leave them out.
    owned = docs.select(F.col(doc_id).alias("_qid"), F.coalesce(F.col(host), F.lit("")).alias("_qhost"), F.xxhash64(_text(text)).alias("_qtext"), F.posexplode_outer(items).alias("_qpos", "_qline"))
    return cut(owned.select("_qid", "_qhost", "_qtext", "_qpos", F.col("_qline.k").alias("_qkey"), F.col("_qline.n").alias("_qn")))


def frequent_lines(table: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, key) of lines of a ``line_table`` that are above their host's limit."""
    per_host = table.groupBy("_qhost", "_qtext").agg(F.lit(1).alias("one")).groupBy("_qhost").agg(F.count("*").alias("_qdocs"))
    keys = table.where("_qkey is not null").groupBy("_qhost", "_qkey", "_qtext").agg(F.lit(1).alias("one"))
    counts = keys.groupBy("_qhost", "_qkey").agg(F.count("*").alias("_qn"))
    above = counts.where(F.col("_qn") > min_docs).join(per_host, "_qhost")
    return above.where(F.col("_qn") > F.least(F.lit(max_docs).cast("double"), max_share * F.col("_qdocs"))).select("_qhost", "_qkey")


def _marked(docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """Per (document, text) with frequent lines: their keys and the number of words in them."""
    table = line_table(docs, doc_id, text, host)
    found = table.join(frequent_lines(table, min_docs, max_share, max_docs), ["_qhost", "_qkey"])
    once = found.repartition("_qid", "_qtext").groupBy("_qid", "_qtext", "_qhost", "_qpos").agg(F.first("_qkey").alias("_qkey"), F.first("_qn").alias("_qn"))
    return once.groupBy("_qid", "_qtext", "_qhost").agg(F.sum("_qn").alias("_qcut"), F.collect_set("_qkey").alias("_qkeys"))


def _joined(rows: DataFrame, marked: DataFrame, doc_id: str, host: str) -> DataFrame:
    marked = marked.select(F.col("_qid").alias("_mid"), F.col("_qtext").alias("_mtext"), F.col("_qhost").alias("_mhost"), *(c for c in ("_qcut", "_qkeys") if c in marked.columns))
    same = F.col(doc_id).eqNullSafe(F.col("_mid")) & (F.col("_qhash") == F.col("_mtext")) & (F.coalesce(F.col(host), F.lit("")) == F.col("_mhost"))
    return rows.join(marked, same, "left").drop("_mid", "_mtext", "_mhost")


def _verdict(min_kept_share: float) -> Column:
    left = F.col("n_words") - F.coalesce(F.col("_qcut"), F.lit(0))
    depleted = (left < MIN_WORDS) | (left < min_kept_share * F.col("n_words"))
    return ~F.col("base_failed") & ~depleted


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row per document: the base counts, the words in frequent lines, and whether it is kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_qbody"), F.col(host).alias("_qsource"))
    rows = base_measures(slim.withColumn("_qhash", F.xxhash64(_text("_qbody"))), "_qbody").drop("_qbody")
    marked = _marked(docs, doc_id, text, host, min_docs, max_share, max_docs).drop("_qkeys")
    out = _joined(rows, marked, "doc_id", "_qsource")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _verdict(min_kept_share).alias("kept"), F.coalesce("_qcut", F.lit(0)).cast("long").alias("n_boilerplate_words"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that are kept, without their frequent lines; columns as they came."""
    rest_of = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*rest_of).alias("_qrow"), F.col(doc_id).alias("_qdoc"), F.col(text).alias("_qbody"), F.col(host).alias("_qsource"))
    rows = base_measures(packed.withColumn("_qhash", F.xxhash64(_text("_qbody"))), "_qbody").where(~F.col("base_failed"))
    out = _joined(rows, _marked(docs, doc_id, text, host, min_docs, max_share, max_docs), "_qdoc", "_qsource").where(_verdict(min_kept_share))
    dropped = lambda line: F.coalesce(F.array_contains(F.col("_qkeys"), line_key(line)), F.lit(False))
    rest = F.array_join(F.filter(F.split("_qbody", "\n", -1), lambda x: ~dropped(x)), "\n")
    new = F.when(F.col("_qkeys").isNull(), F.col("_qbody")).otherwise(rest)
    return out.select(*(new.alias(c) if c == text else F.col("_qrow")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, host, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, i - before)) AS n_rep
        FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -10) AS before FROM dup) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN cov USING (doc_id)),
ln AS (SELECT doc_id, host, body, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
              trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS k
       FROM (SELECT doc_id, host, body, unnest(ls) AS l FROM w)),
freq AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT body) AS n FROM ln GROUP BY host, k)
         JOIN (SELECT host, count(DISTINCT body) AS docs FROM d GROUP BY host) USING (host) WHERE n > 10 AND (n > 0.1 * docs OR n > 100)),
gone AS (SELECT doc_id, sum(n) AS gone FROM ln JOIN freq USING (host, k) GROUP BY doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(gone, 0)::BIGINT AS n_boilerplate_words
      FROM base LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_boilerplate_words >= 10 AND n_words - n_boilerplate_words >= 0.3 * n_words AS kept,
       n_boilerplate_words
FROM v
"""
