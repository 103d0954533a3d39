"""A folder of notes as a graph: links, backlinks, extraction state, and the view of it all.

``sections`` is (id, path, heading, ord, line, text, key), as the chunker makes it; ``files`` has the
paths of all notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import knowledge

SNIPPET = 200


def links(sections: DataFrame, files: DataFrame, folder: str = "") -> DataFrame:
    """(source, target, line, text, place) of [[links]] in notes under ``folder``.

    A name means the notes with its stem; with a slash, those whose path ends with it, if any. Of
    several, one in the linking note's folder (for a note at the root: at the root) comes first, then
    the shortest path, then the least. ``place`` numbers the links of a note.
    """
    rows = sections.where(tx.in_folder(F.col("path"), folder)).select(F.col("path").alias("source"), "ord", "line", F.posexplode(F.split("text", "\n")).alias("offset", "row"))
    rows = rows.select("source", "ord", (F.col("line") + F.col("offset")).alias("line"), F.left(tx.strip(F.col("row")), F.lit(SNIPPET)).alias("text"), F.posexplode(tx.wikilinks(F.col("row"))).alias("nth", "name"))
    rows = rows.withColumn("link", F.struct("source", "ord", "line", "nth"))
    targets = files.select(F.col("path").alias("target"), tx.stem(F.col("path")).alias("stem"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"\.md$", "")
    here = F.when(F.col("source").contains("/"), F.regexp_replace("source", "/[^/]*$", ""))
    near = F.when(here.isNull(), ~F.col("target").contains("/")).otherwise(F.col("target").startswith(F.concat(here, F.lit("/"))))
    ends = F.when(F.col("name").contains("/"), bare(F.col("target")).endswith(bare(F.col("name")))).otherwise(False)
    order = F.struct((~ends).cast("int"), (~near).cast("int"), F.length("target"), F.col("target"))
    found = rows.withColumn("stem", tx.stem(F.col("name"))).join(targets, "stem").groupBy("link").agg(F.min_by("target", order).alias("target"), F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("link.source").orderBy("link.ord", "link.line", "link.nth"))
    return found.select("link.source", "target", "link.line", "text", place.alias("place"))


def backlinks(all_links: DataFrame, path: str | None = None) -> DataFrame:
    """(target, path, line, text): links from other notes, to one note or to all."""
    rows = all_links.where("source != target") if path is None else all_links.where((F.col("target") == path) & (F.col("source") != path))
    return rows.select("target", F.col("source").alias("path"), "line", "text")


def pending(sections: DataFrame, extracted: DataFrame, folder: str = "") -> DataFrame:
    """Sections whose key was not extracted; of equal ones the first in reading order."""
    order = Window.partitionBy("key").orderBy("path", "ord")
    todo = sections.where(tx.in_folder(F.col("path"), folder)).join(extracted.select("key").distinct(), "key", "left_anti")
    return todo.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def extraction_stats(sections: DataFrame, extracted: DataFrame, folder: str = "") -> DataFrame:
    """One row: chunks, and the distinct keys that are extracted and pending."""
    own = sections.where(tx.in_folder(F.col("path"), folder))
    done = extracted.select("key").distinct().withColumn("done", F.lit(1))
    counted = own.groupBy("key").agg(F.count("*").alias("n")).join(done, "key", "left")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("done").alias("extracted"), F.count_if(F.col("done").isNull()).alias("pending"))


def facts(sections: DataFrame, triples: DataFrame, folder: str = "") -> DataFrame:
    """Triples (ord, key, source, ...) with the sections that hold them, with canonical labels.

    A section copied into two notes gives its facts twice; ``ord`` stays that of the triple, and
    ``place`` numbers the facts.
    """
    own = sections.where(tx.in_folder(F.col("path"), folder)).select("key", F.col("id").alias("source_chunk_id"), "path", "heading", F.col("ord").alias("section_ord"))
    rows = triples.select("ord", "key", "source", "relation", "target", "evidence", "confidence").join(own, "key")
    rows = rows.withColumn("ord", F.struct("ord", "path", "section_ord"))
    return knowledge.normalize(rows)


def view(sections: DataFrame, all_links: DataFrame, fact_rows: DataFrame, folder: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) of notes and entities; equal edges are one, self-loops count twice."""
    note = lambda c: F.concat(F.lit("note:"), c)
    entity = lambda c: F.concat(F.lit("entity:"), c)
    own = sections.where(tx.in_folder(F.col("path"), folder)).select("path").distinct()
    nothing = F.lit(None).cast("string")
    named = fact_rows.select("path", F.explode(F.array("source", "target")).alias("name")).distinct()
    raw = all_links.select(note(F.col("source")).alias("source"), note(F.col("target")).alias("target"), F.lit("link").alias("kind"), nothing.alias("label"), nothing.alias("evidence"), nothing.alias("path"))
    raw = raw.union(fact_rows.select(entity(F.col("source")), entity(F.col("target")), F.lit("relation"), "relation", "evidence", "path"))
    raw = raw.union(named.select(note(F.col("path")), entity(F.col("name")), F.lit("mention"), nothing, nothing, nothing))
    edges = raw.groupBy("source", "target", "kind", "label").agg(F.min(F.struct("path", "evidence")).alias("x")).select("source", "target", "kind", "label", "x.evidence", "x.path")
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    paths = own.select("path").union(all_links.select("target")).distinct()
    nodes = paths.select(note(F.col("path")).alias("id"), tx.stem(F.col("path")).alias("label"), F.lit("note").alias("kind"), "path")
    nodes = nodes.union(named.select("name").distinct().select(entity(F.col("name")), "name", F.lit("entity"), nothing))
    nodes = nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(own, "notes").crossJoin(count(named.select("name").distinct(), "entities")).crossJoin(count(fact_rows, "relations")).crossJoin(count(all_links, "links"))
    return nodes, edges, stats
