"""Queries on sessions, answers and file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import mutations, sessions
from skein.plans import graph_queries, retrieval_queries
from skein.plans.registry import Catalog
from skein.sources.tables import load

catalog = Catalog()


@catalog.add(
    """WITH t AS (SELECT conv_id AS id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Attached file n' || turn || '.md: 3 pages Full text:' || chr(10) || 'x' ELSE '' END AS task FROM conversations)
SELECT id, turn, left(string_split(task, chr(10) || chr(10) || 'Attached file ')[1], 120) AS title, CASE WHEN turn % 2 = 0 THEN 'n' || turn || '.md' END AS name,
  CASE WHEN turn % 2 = 0 THEN 'Attached file n' || turn || '.md: 3 pages' END AS note FROM t"""
)
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n\nAttached file n"), turn, F.lit(".md: 3 pages Full text:\nx"))).otherwise("")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.concat("text", note).alias("task"))
    first = F.get(sessions.attachments(F.col("task")), F.lit(0))
    return rows.select("id", "turn", F.left(sessions.message_head(F.col("task")), F.lit(120)).alias("title"), first["name"].alias("name"), first["note"].alias("note"))


@catalog.add(
    """SELECT conv_id, turn, 'see [Plan b](wikilink:a%20plan' || turn || ') and [x' || conv_id || ' › H2](note:d%2Fx' || conv_id || '.md) [y](note:y.txt) (not a citation.md, no)' AS text FROM conversations"""
)
def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = F.col("conv_id").cast("string")
    text = F.concat(F.lit("see [[a plan"), F.col("turn").cast("string"), F.lit("|Plan b]] and (d/x"), name, F.lit(".md > H1 > H2; y.txt) (not a citation.md, no)"))
    return rows.select("conv_id", "turn", sessions.with_links(sessions.with_citations(text)).alias("text"))


@catalog.add(
    f"""WITH {graph_queries.SECTIONS}, r AS (SELECT conv_id AS rid, 'Note' || ((conv_id * 3) % 60) AS name, 'team' || (conv_id % 5) AS here FROM (SELECT DISTINCT conv_id FROM conversations)),
c AS (SELECT rid, path, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN regexp_replace(path, '/[^/]*$', '') = here THEN 0 ELSE 1 END, path) AS n FROM r JOIN f ON regexp_extract(path, '([^/]*)\\.md$', 1) = lower(name))
SELECT rid, path FROM c WHERE n = 1"""
)
def opened_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    asked = ids.select(F.col("conv_id").alias("rid"), F.concat(F.lit("Note"), (F.col("conv_id") * 3 % 60).cast("string")).alias("name"), F.concat(F.lit("team"), (F.col("conv_id") % 5).cast("string")).alias("here"))
    return sessions.open_note(asked, graph_queries.sections(spark, sf_dir).select("path").distinct())


@catalog.add(
    f"SELECT count(DISTINCT w) AS distinct_tokens, (SELECT round(avg(len({retrieval_queries.TOKENS})), 6) FROM documents) AS tokens_per_passage FROM (SELECT unnest({retrieval_queries.TOKENS}) AS w FROM documents)"
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.token_statistics(load(spark, sf_dir, "documents"))


@catalog.add(
    """WITH f AS (SELECT 'f' || doc_id AS path, text, doc_id FROM documents)
SELECT path, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM (SELECT CASE WHEN doc_id % 5 = 2 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 1 THEN 'new' ELSE text END ||
  CASE WHEN doc_id % 5 IN (1, 3) THEN CASE WHEN (CASE WHEN doc_id % 5 = 1 THEN 'new' ELSE text END) IN ('') OR ends_with(CASE WHEN doc_id % 5 = 1 THEN 'new' ELSE text END, chr(10)) THEN '' ELSE chr(10) END || 'more' ELSE '' END AS text
FROM f WHERE doc_id % 5 != 4)"""
)
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth file is written, moved, appended to or deleted; the written ones are appended to as well."""
    rows = load(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    part, nothing = F.col("doc_id") % 5, F.lit(None).cast("string")
    ends = rows.where(part.isin(1, 2, 4)).select(F.lit(1).alias("seq"), F.when(part == 1, "write").when(part == 2, "move").otherwise("delete").alias("kind"), "path", F.when(part == 2, F.concat(F.lit("moved/"), "path")).alias("dest"), F.when(part == 1, "new").alias("text"))
    more = rows.where(part.isin(1, 3)).select(F.lit(2), F.lit("append"), "path", nothing, F.lit("more"))
    files = mutations.apply_changes(rows.drop("doc_id"), ends.union(more))[0]
    return files.select("path", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


#: Ten changes of four paths for each document, by a rule on its id and the change's number.
CHANGES = 10
_MIX = "(doc_id * 7919 + k * 104729 + k * k * 31)"


@catalog.add(
    f"""WITH RECURSIVE ops AS (SELECT doc_id, k, ['write', 'append', 'move', 'move', 'delete', 'append', 'move'][{_MIX} % 7 + 1] AS kind, {_MIX} // 7 % 4 AS src, {_MIX} // 28 % 4 AS dst
  FROM documents, range(1, {CHANGES} + 1) r(k)),
s AS (SELECT doc_id, 0::BIGINT AS k, [{{'p': 0::BIGINT, 't': text}}] AS f, []::STRUCT(p BIGINT, t VARCHAR)[] AS trash FROM documents
UNION ALL SELECT s.doc_id, o.k, CASE
    WHEN kind = 'write' THEN list_append(list_filter(f, lambda x: x.p != src), {{'p': src, 't': 'w' || o.k}})
    WHEN kind = 'append' THEN list_append(list_filter(f, lambda x: x.p != src), {{'p': src, 't': coalesce(old || CASE WHEN old = '' OR ends_with(old, chr(10)) THEN '' ELSE chr(10) END, '') || 'a' || o.k}})
    WHEN kind = 'delete' THEN list_filter(f, lambda x: x.p != src)
    WHEN old IS NOT NULL AND len(list_filter(f, lambda x: x.p = dst)) = 0 THEN list_transform(f, lambda x: {{'p': CASE WHEN x.p = src THEN dst ELSE x.p END, 't': x.t}})
    ELSE f END, CASE WHEN kind = 'delete' AND old IS NOT NULL THEN list_append(trash, {{'p': src, 't': old}}) ELSE trash END
  FROM (SELECT s.*, o.* EXCLUDE (doc_id, k), list_filter(f, lambda x: x.p = src)[1].t AS old FROM s JOIN ops o ON s.doc_id = o.doc_id AND o.k = s.k + 1) s, (SELECT s.k + 1 AS k) o),
e AS (SELECT doc_id, 'file' AS place, unnest(f) AS x FROM s WHERE k = {CHANGES} UNION ALL SELECT doc_id, 'trash', unnest(trash) FROM s WHERE k = {CHANGES})
SELECT place, 'f' || doc_id || '/' || x.p AS path, length(x.t)::BIGINT AS n_chars, md5(x.t) AS digest FROM e"""
)
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's file goes through writes, appends, deletes and chains of moves over four paths."""
    docs = load(spark, sf_dir, "documents")
    ops = docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(CHANGES).cast("long"))).alias("k")).withColumn("h", F.expr(_MIX))
    path = lambda n: F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("/"), n.cast("string"))
    kind = F.get(F.array(*map(F.lit, ("write", "append", "move", "move", "delete", "append", "move"))), (F.col("h") % 7).cast("int"))
    text = F.concat(F.left(kind, F.lit(1)), F.col("k").cast("string"))
    changes = ops.select(F.col("k").alias("seq"), kind.alias("kind"), path(F.expr("h div 7 % 4")).alias("path"), path(F.expr("h div 28 % 4")).alias("dest"), text.alias("text"))
    kept, trash = mutations.apply_changes(docs.select(path(F.lit(0)).alias("path"), "text"), changes)
    both = kept.withColumn("place", F.lit("file")).unionByName(trash.withColumn("place", F.lit("trash")))
    return both.select("place", "path", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@catalog.add(
    f"""WITH {graph_queries.FACTS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM ed) GROUP BY id)
SELECT 'note:' || path AS id, round(sqrt(coalesce(degree, 0)), 6) AS radius FROM f LEFT JOIN deg ON id = 'note:' || path"""
)
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of the graph view, without entities."""
    nodes = graph_queries.notes_view_nodes(spark, sf_dir)
    return sessions.visible(nodes, graph_queries.notes_view_edges(spark, sf_dir), ["entity", "mention", "relation"])[0].select("id", "radius")
