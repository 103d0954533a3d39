"""Retrieval queries over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html as hx
from skein.functions import text as tx
from skein.operators import bm25, chunking, dense, entity_graph, evaluation, fusion, substrings
from skein.plans.registry import Catalog
from skein.plans.retrieval import WIDER, Searcher
from skein.sources.tables import load

catalog = Catalog()
K = 5
W = r"\p{L}\p{N}_"
TOKENS = rf"regexp_extract_all(lower(translate(text, '{tx.THAI_DIGITS}', '{tx.DIGITS}')), '[{W}]{{2,}}')"
FULL_TEXT_TOKENS = rf"regexp_extract_all(array_to_string({TOKENS}, ' '), '[\p{{L}}\p{{N}}]+')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def searcher(spark: SparkSession, sf_dir: str) -> Searcher:
    """All documents; the encoder looks vectors up in place of a model.

    There are fewer vectors than documents, which take them in turn by their number.
    A question's vector is that of the same number (of the number plus 100 when widened), at half
    length for odd numbers, so that weak evidence occurs.
    """
    known = vectors(spark, sf_dir)
    numbered = known.withColumnRenamed("id", "_number")
    docs = documents(spark, sf_dir).withColumn("_number", F.col("id") % F.lit(known.count())).join(numbered, "_number").drop("_number").withColumn("file", F.lit("corpus")).withColumn("page", F.col("id"))
    scale = F.when(F.col("qid") % 2 == 1, 0.5).otherwise(1.0)

    def encode(queries: DataFrame) -> DataFrame:
        number = F.col("qid") + F.when(F.col("text").endswith(WIDER), 100).otherwise(0)
        found = queries.withColumn("_number", number).join(numbered, "_number")
        return found.select("qid", "text", F.transform("vec", lambda x: (x * scale).cast("float")).alias("vec"))

    images = known.select(F.lit("corpus").alias("file"), (F.col("id") + 7).alias("page"), "vec")
    return Searcher(docs, encode, images=images, encode_image_query=encode)


def _okapi(queries: str, passages: str, name: str, k: int) -> str:
    return f"""
{name}_p AS (SELECT id, {TOKENS} AS ws FROM {passages}),
{name}_l AS (SELECT id, len(ws) AS length FROM {name}_p),
{name}_t AS (SELECT count(*) AS n, avg(length) AS average FROM {name}_l),
{name}_o AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM {name}_p) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS w FROM {name}_o GROUP BY term),
{name}_q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOKENS}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (SELECT qid, id, round(sum(times * ln(1 + (n - w + 0.5) / (w + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
             FROM {name}_q JOIN {name}_o USING (term) JOIN {name}_d USING (term) JOIN {name}_l USING (id), {name}_t GROUP BY qid, id),
{name}_a AS (SELECT {queries}.qid, {passages}.id, coalesce(score, 0.0) AS score FROM {queries} CROSS JOIN {passages} LEFT JOIN {name}_s USING (qid, id)),
{name} AS (SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_a) WHERE rank <= {k})"""


def _full_text(queries: str, passages: str, name: str, k: int) -> str:
    return f"""
{name}_p AS (SELECT id, {FULL_TEXT_TOKENS} AS ws FROM {passages}),
{name}_l AS (SELECT id, len(ws) AS length FROM {name}_p),
{name}_t AS (SELECT count(*) AS n, avg(length) AS average FROM {name}_l),
{name}_o AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM {name}_p) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS w FROM {name}_o GROUP BY term),
{name}_q AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({FULL_TEXT_TOKENS}) AS term FROM {queries})),
{name}_s AS (SELECT qid, id, round(sum(greatest(ln((n - w + 0.5) / (w + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
             FROM {name}_q JOIN {name}_o USING (term) JOIN {name}_d USING (term) JOIN {name}_l USING (id), {name}_t GROUP BY qid, id),
{name} AS (SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _dense(queries: str, passages: str, name: str, k: int) -> str:
    return f"""
{name}_s AS (SELECT qid, id, round(list_dot_product(q.vec::DOUBLE[], p.vec::DOUBLE[]), 6) AS score FROM {queries} q CROSS JOIN {passages} p),
{name} AS (SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _fuse(lists: list[str], name: str, k: int) -> str:
    rows = " UNION ALL ".join(f"SELECT qid, rank, id, {i} AS list_no FROM {x}" for i, x in enumerate(lists))
    return f"""
{name}_u AS ({rows}),
{name}_s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000000 + rank) AS first FROM {name}_u GROUP BY qid, id),
{name} AS (SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


DOCS = "p AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark)"
WITH_VECTORS = """p AS (SELECT doc_id AS id, text, embedding AS vec FROM documents JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id),
q AS (SELECT item_id AS qid, text, list_transform(embedding, lambda x: (x * CASE WHEN item_id % 2 = 1 THEN 0.5 ELSE 1.0 END)::FLOAT) AS vec
      FROM benchmark JOIN embeddings ON item_id = vec_id)"""
RANKED = "SELECT qid, rank::INT AS rank, id, score FROM"


@catalog.add(f"WITH {DOCS}, {_okapi('q', 'p', 'r', K)} {RANKED} r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(questions(spark, sf_dir), documents(spark, sf_dir), K)


@catalog.add(f"WITH {DOCS}, {_full_text('q', 'p', 'r', K)} {RANKED} r")
def bm25_full_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(questions(spark, sf_dir), documents(spark, sf_dir), K, bm25.FULL_TEXT)


@catalog.add(f"WITH p AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), q AS (SELECT id AS qid, vec FROM p WHERE id % 50 = 0), {_dense('q', 'p', 'r', 10)} {RANKED} r")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all vectors."""
    rows = vectors(spark, sf_dir)
    return dense.search(rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), rows, 10)


@catalog.add(f"WITH {DOCS}, {_okapi('q', 'p', 'a', 25)}, {_full_text('q', 'p', 'b', 25)}, {_fuse(['a', 'b'], 'r', K)} {RANKED} r")
def fused_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the two BM25 profiles over all documents."""
    q, p = questions(spark, sf_dir), documents(spark, sf_dir)
    return fusion.fuse([bm25.search(q, p, 25), bm25.search(q, p, 25, bm25.FULL_TEXT)], K)


@catalog.add(f"WITH {WITH_VECTORS}, {_okapi('q', 'p', 'b', 25)}, {_dense('q', 'p', 'a', 25)}, {_fuse(['a', 'b'], 'r', K)} {RANKED} r")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).search(questions(spark, sf_dir), "hybrid", K)


EDGES = rf"""
m AS (SELECT id, unnest(list_sort(list_distinct(regexp_extract_all(text, '{tx.ENTITY}', 1)))[1:30]) AS entity FROM p),
f AS (SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY id) AS place FROM m),
n AS (SELECT id AS src, lead(id) OVER (PARTITION BY entity ORDER BY id) AS dst FROM f WHERE place <= 100),
edge AS (SELECT src, dst FROM n WHERE dst IS NOT NULL AND src != dst UNION SELECT dst, src FROM n WHERE dst IS NOT NULL AND src != dst)"""


@catalog.add(
    f"""WITH {WITH_VECTORS}, {EDGES}, {_dense('q', 'p', 'a', 8)},
e AS (SELECT qid, id FROM a UNION SELECT qid, dst FROM a JOIN edge ON id = src),
s AS (SELECT qid, e.id, round(list_dot_product(q.vec::DOUBLE[], p.vec::DOUBLE[]), 6) AS score FROM e JOIN q USING (qid) JOIN p ON p.id = e.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) {RANKED} r WHERE rank <= {K}"""
)
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).search(questions(spark, sf_dir), "graph", K)


@catalog.add(
    f"""WITH {WITH_VECTORS}, lq AS (SELECT * FROM q WHERE len({TOKENS}) > 5), {_dense('q', 'p', 'a', 25)}, {_okapi('lq', 'p', 'b', 25)}, {_fuse(['a', 'b'], 'f', K)},
strong AS (SELECT qid FROM a WHERE rank = 1 AND score >= 0.72),
wq AS (SELECT item_id AS qid, list_transform(embedding, lambda x: (x * CASE WHEN item_id % 2 = 1 THEN 0.5 ELSE 1.0 END)::FLOAT) AS vec
       FROM benchmark JOIN embeddings ON item_id + 100 = vec_id WHERE item_id NOT IN (SELECT qid FROM strong)),
weak AS (SELECT * FROM f WHERE qid NOT IN (SELECT qid FROM strong)), {_dense('wq', 'p', 'c', 25)}, {_fuse(['weak', 'c'], 'g', K)}
{RANKED} f WHERE qid IN (SELECT qid FROM strong) UNION ALL {RANKED} g"""
)
def agentic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).search(questions(spark, sf_dir), "agentic", K)


@catalog.add(
    f"""WITH {WITH_VECTORS}, {_dense('q', 'p', 'a', 25)}, good AS (SELECT qid FROM a WHERE rank = 1 AND score >= 0.75),
pq AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM good)), pa AS (SELECT * FROM a WHERE qid NOT IN (SELECT qid FROM good)),
{_okapi('pq', 'p', 'b', 25)}, {_fuse(['pa', 'b'], 'f', K)}
{RANKED} a WHERE rank <= {K} AND qid IN (SELECT qid FROM good) UNION ALL {RANKED} f"""
)
def corrective_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).search(questions(spark, sf_dir), "corrective", K)


@catalog.add(
    f"""WITH {WITH_VECTORS}, i AS (SELECT p.id, embedding AS vec FROM p JOIN embeddings ON p.id = vec_id + 7), {_dense('q', 'p', 'a', 25)}, {_dense('q', 'i', 'b', 25)},
{_fuse(['a', 'b'], 'r', K)} {RANKED} r"""
)
def multimodal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).search(questions(spark, sf_dir), "multimodal", K)


@catalog.add(
    """WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '\\s+'), lambda w: w != '') AS ws FROM documents),
s AS (SELECT id, ws, unnest(generate_series(0, CASE WHEN len(ws) <= 260 THEN 0 ELSE ((len(ws) - 260 + 219) // 220) * 220 END, 220)) AS start FROM d WHERE len(ws) > 0)
SELECT id, start::INT AS start, len(ws[start + 1:start + 260])::INT AS n_words, array_to_string(ws[start + 1:start + 260], ' ') AS text FROM s"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(documents(spark, sf_dir), ["id"])


@catalog.add(f"WITH {DOCS}, {EDGES} SELECT id, entity FROM m")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_graph.mentions(documents(spark, sf_dir))


@catalog.add(f"WITH {DOCS}, {EDGES} SELECT src, dst FROM edge")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_graph.edges(documents(spark, sf_dir))


@catalog.add(
    r"""WITH l AS (SELECT doc_id AS key, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents)),
s AS (SELECT key, line_no, line, unnest(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence,
             unnest(generate_series(1, len(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS part_no FROM l),
f AS (SELECT *, lower(trim(regexp_replace(sentence, '\s+', ' ', 'g'), ' ')) AS form FROM s),
r AS (SELECT *, length(form) >= 40 AND row_number() OVER (PARTITION BY key, form ORDER BY line_no, part_no) > 1 AS again FROM f),
j AS (SELECT key, line_no, any_value(line) AS line, bool_or(again) AS cut, count(*) FILTER (NOT again) AS n,
             rtrim(coalesce(string_agg(sentence, ' ' ORDER BY part_no) FILTER (NOT again), '')) AS new FROM r GROUP BY key, line_no)
SELECT key, coalesce(string_agg(new, chr(10) ORDER BY line_no) FILTER (n > 0 OR trim(line) = ''), '') AS text, bool_or(cut) AS looped FROM j GROUP BY key"""
)
def drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.drop_repeats(load(spark, sf_dir, "documents"), "doc_id")


@catalog.add(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text,
length(text) < 100 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(text), 1) < 0.25 AS needs_ocr,
length(text) // 4 AS attachment_tokens, length(text) // 3 + 4 AS message_tokens,
CASE WHEN length(text) <= 4000 THEN text ELSE left(text, 2000) || chr(10) || '... [truncated ' || (length(text) - 4000) || ' chars] ...' || chr(10) || right(text, 2000) END AS truncated,
CASE WHEN length(text) <= 70 THEN replace(text, chr(10), ' ⏎ ') ELSE left(replace(text, chr(10), ' ⏎ '), 69) || '…' END AS brief,
substr(sha1('doc' || chr(0) || text), 1, 16) AS section_key FROM documents"""
)
def page_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", tx.normalize(text).alias("text"), tx.needs_ocr(text).alias("needs_ocr"), tx.attachment_tokens(text).alias("attachment_tokens"), tx.message_tokens(text).alias("message_tokens"),
        tx.truncate(text, 4000).alias("truncated"), tx.brief(text).alias("brief"), tx.section_key(F.lit("doc"), text).alias("section_key"),
    )


@catalog.add()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hx.convert(load(spark, sf_dir, "pages"))


@catalog.add()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.hash_embed(documents(spark, sf_dir)).select("id", "vec")


GOLD = "g AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
SCORES = """w AS (SELECT qid, count(*) AS gold FROM (SELECT DISTINCT qid, id FROM g) GROUP BY qid),
h AS (SELECT qid, min(rank) AS first, count(DISTINCT id) FILTER (rank <= 5) AS found5 FROM r JOIN (SELECT DISTINCT qid, id FROM g) USING (qid, id) GROUP BY qid),
s AS (SELECT qid, coalesce(first <= 5, false)::INT AS hit5, coalesce(1.0::DOUBLE / first, 0.0) AS rr10, coalesce(found5, 0)::DOUBLE / gold AS gold_found5 FROM w LEFT JOIN h USING (qid))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = questions(spark, sf_dir), documents(spark, sf_dir)
    passages = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    gold = substrings.containing(p, passages, needle="passage").join(passages, F.col("needle") == F.col("passage")).select("qid", "id")
    return evaluation.score(bm25.search(q, p, 10), gold, ["id"])


@catalog.add(f"WITH {DOCS}, {_okapi('q', 'p', 'r', 10)}, {GOLD}, {SCORES} SELECT qid, hit5, round(rr10, 6) AS rr10, round(gold_found5, 6) AS gold_found5 FROM s")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits of each benchmark passage against the documents that contain it."""
    return _scores(spark, sf_dir).select("qid", "hit5", F.round("rr10", 6).alias("rr10"), F.round("gold_found5", 6).alias("gold_found5"))


@catalog.add(
    f"""WITH {DOCS}, {_okapi('q', 'p', 'r', 10)}, {GOLD}, {SCORES}
SELECT part, count(*) AS n, round(avg(hit5), 6) AS hit5, round(avg(rr10), 6) AS mrr10, round(avg(gold_found5), 6) AS gold_found5 FROM (SELECT *, qid % 4 AS part FROM s) GROUP BY ROLLUP (part)"""
)
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_scores(spark, sf_dir).withColumn("part", F.col("qid") % 4), "part")


#: DuckDB's edit distance counts bytes, so accented letters are put as other single bytes there.
LETTERS_OF = "translate({}, 'éèêçñóíäöüßÉÈÊÇÑÓÍÄÖÜ', '0123456789#$%&*+<>=@^~')"


@catalog.add(
    rf"""WITH x AS (SELECT a.item_id AS key, a.text || ' 1,' || (100 + a.item_id) || ' 2.5 ' || a.item_id % 3 AS t, b.text || ' 1' || (100 + a.item_id) || ' 2.5' AS r FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)),
w AS (SELECT key, 'w' AS kind, unnest(regexp_extract_all(lower(t), '[{W}]{{2,}}')) AS item, 1 AS want, 0 AS got FROM x UNION ALL
      SELECT key, 'w', unnest(regexp_extract_all(lower(r), '[{W}]{{2,}}')), 0, 1 FROM x),
c AS (SELECT key, item, sum(want) AS want, sum(got) AS got FROM w GROUP BY key, item),
s AS (SELECT key, sum(least(want, got))::DOUBLE / greatest(sum(want), 1) AS word_recall FROM c GROUP BY key),
nw AS (SELECT key, replace(unnest(regexp_extract_all(t, '[0-9][0-9,]*(?:\.[0-9]+)?')), ',', '') AS item, 1 AS want, 0 AS got FROM x UNION ALL
      SELECT key, replace(unnest(regexp_extract_all(r, '[0-9][0-9,]*(?:\.[0-9]+)?')), ',', ''), 0, 1 FROM x),
nc AS (SELECT key, item, sum(want) AS want, sum(got) AS got FROM nw GROUP BY key, item),
ns AS (SELECT key, sum(least(want, got))::DOUBLE / greatest(sum(want), 1) AS number_recall FROM nc GROUP BY key)
SELECT key, round(levenshtein({LETTERS_OF.format('t')}, {LETTERS_OF.format('r')})::DOUBLE / greatest(length(t), 1), 6) AS cer, round(coalesce(word_recall, 0), 6) AS word_recall, round(coalesce(number_recall, 0), 6) AS number_recall FROM x LEFT JOIN s USING (key) LEFT JOIN ns USING (key)"""
)
def reading_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as if it were a reading of the one before it; three numbers are added, of which two are read."""
    rows = load(spark, sf_dir, "benchmark")
    n = rows.agg(F.count("*").alias("n"))
    following = rows.crossJoin(n).select(((F.col("item_id") + F.col("n") - 1) % F.col("n")).alias("key"), F.col("text").alias("read"))
    number = (F.col("key") + 100).cast("string")
    pairs = rows.select(F.col("item_id").alias("key"), "text").join(following, "key")
    truth = F.concat("text", F.lit(" 1,"), number, F.lit(" 2.5 "), (F.col("key") % 3).cast("string"))
    pairs = pairs.select("key", truth.alias("truth"), F.concat("read", F.lit(" 1"), number, F.lit(" 2.5")).alias("read"))
    return evaluation.reading_accuracy(pairs, "key", "truth", "read")
