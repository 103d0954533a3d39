"""Knowledge graphs from triples: validation, canonical labels, seeds, breadth-first subgraphs.

A triple is (ord, source, relation, target, evidence, confidence, source_chunk_id), with ``ord`` its
place in the input. Many queries run in one job: seeds and subgraphs carry a ``qid``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import substrings
from skein.plans.lineage import cut

#: Words that never seed a search.
STOPWORDS = (
    "a an and are as at be but by did do does for from had has have how if in into is it its no not of on or that the "
    "their then there these they this to was were what when where which who whom why will with"
).split()
PREFIX = 5
EMPTY_CONTEXT = "Graph evidence: (no relevant graph context found)"


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): cleaned triples, and the raw ones with the first reason against them."""
    reason: Column = F.lit(None).cast("string")
    number = F.col("confidence").cast("string")
    reason = F.when(number.isNotNull() & number.try_cast("double").isNull(), F.lit("'confidence' must be numeric"))
    for name in ("target", "relation", "source"):
        reason = F.when(F.coalesce(tx.collapse(F.col(name)), F.lit("")) == "", F.lit(f"'{name}' must be a non-empty string")).otherwise(reason)
    marked = raw.withColumn("reason", reason)
    cleaned = [tx.collapse(F.col(c)).alias(c) for c in ("source", "relation", "target")]
    valid = marked.where("reason is null").select(
        "ord", *cleaned, F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce(number.try_cast("double"), F.lit(0.5)).alias("confidence"), F.col("source_chunk_id").cast("string").alias("source_chunk_id")
    )
    return valid, marked.where("reason is not null")


def labels(triples: DataFrame) -> DataFrame:
    """(ord, place, label): every mention of an entity, in input order."""
    both = F.array(F.struct(F.lit(0).alias("place"), F.col("source").alias("label")), F.struct(F.lit(1).alias("place"), F.col("target").alias("label")))
    return triples.select("ord", F.explode(both).alias("x")).select("ord", "x.place", tx.collapse(F.col("x.label")).alias("label"))


def canonical_labels(triples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, label): one display label per matching key.

    A label without a leading article is better than one with it, then one with more capitalised
    words, then a longer one, then the earlier one; that is a total order, so one aggregation finds
    the best. ``aliases`` (ord, canonical, variant) overrule it; of several, the last.
    """
    article = F.lower("label").rlike("^(the|a|an) ").cast("int")
    capitals = F.size(F.filter(F.split("label", " "), lambda w: w.rlike(r"^\p{Lu}")))
    rank = F.struct(article, -capitals, -F.length("label"), F.col("ord"), F.col("place"))
    keyed = labels(triples).withColumn("key", tx.entity_key(F.col("label"))).where("key != ''")
    best = keyed.groupBy("key").agg(F.min_by("label", rank).alias("label"))
    bare = F.trim(F.regexp_replace("label", "(?i)^(the|a|an) ", ""))
    best = best.withColumn("label", F.when(bare != "", bare).otherwise(F.col("label")))
    if aliases is None:
        return best
    names = aliases.select("ord", tx.collapse(F.col("canonical")).alias("label"), F.explode(F.array("canonical", "variant")).alias("name")).where("label != ''")
    given = names.withColumn("key", tx.entity_key(F.col("name"))).where("key is not null and key != ''").groupBy("key").agg(F.max_by("label", "ord").alias("label"))
    return given.unionByName(best.join(given, "key", "left_anti"))


def normalize(triples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``triples`` with canonical labels as endpoints; labels without a key stay."""
    names = canonical_labels(triples, aliases)
    out = triples
    for end in ("source", "target"):
        found = names.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
        out = out.withColumn("_key", tx.entity_key(F.col(end))).join(found, "_key", "left").withColumn(end, F.coalesce("_label", end)).drop("_key", "_label")
    return out.select(*triples.columns)


def alias_report(triples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(label, variants): the other spellings of each canonical label, sorted."""
    named = labels(triples).withColumn("key", tx.entity_key(F.col("label"))).withColumnRenamed("label", "variant")
    joined = named.join(canonical_labels(triples, aliases), "key").where("variant != label")
    return joined.groupBy("label").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def nodes(triples: DataFrame) -> DataFrame:
    """(node, place): the distinct endpoints with the place of their first mention."""
    return labels(triples).groupBy(F.col("label").alias("node")).agg(F.min(F.struct("ord", "place")).alias("first"))


def seeds_by_name(triples: DataFrame, names: DataFrame, mode: str = "normalized", aliases: DataFrame | None = None) -> DataFrame:
    """(qid, node) for ``names`` (qid, name): labels that a name means, never by substring.

    ``exact`` ignores case only, ``normalized`` compares matching keys, and ``alias`` also follows
    ``aliases`` (name, alias), themselves compared by key.
    """
    if mode not in ("exact", "normalized", "alias"):
        raise ValueError(f"mode {mode!r} is none of exact, normalized and alias")
    if mode == "exact":
        last = nodes(triples).groupBy(F.lower("node").alias("key")).agg(F.max_by("node", "first").alias("node"))
        wanted = names.select("qid", F.lower(tx.collapse(F.col("name"))).alias("key"))
        return wanted.join(last, "key").select("qid", "node").distinct()
    first = nodes(triples).groupBy(tx.entity_key(F.col("node")).alias("key")).agg(F.min_by("node", "first").alias("node"))
    wanted = names.select("qid", tx.entity_key(F.col("name")).alias("key"))
    if mode == "alias" and aliases is not None:
        means = aliases.select(tx.entity_key(F.col("name")).alias("key"), tx.entity_key(F.col("alias")).alias("other"))
        wanted = wanted.union(wanted.join(means, "key").select("qid", "other"))
    return wanted.join(first, "key").select("qid", "node").distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, needle) of ``queries`` (qid, text): what a triple must contain to match a word.

    A word of five letters or more matches by its first five, which covers the whole word.
    """
    words = queries.select("qid", F.explode(tx.tokens(F.coalesce("text", F.lit("")))).alias("word"))
    thai = F.col("word").rlike("[฀-๿]")
    kept = words.where(thai | ((F.length("word") > 2) & ~F.col("word").isin(STOPWORDS)))
    return kept.select("qid", F.when(F.length("word") >= PREFIX, F.left("word", F.lit(PREFIX))).otherwise(F.col("word")).alias("needle")).distinct()


def seeds_by_query(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, node): both ends of every triple whose text contains a word of the query.

    Triples are found from the distinct needles of all queries by an index of grams, queries from the
    needles by an equi-join.
    """
    terms = query_terms(queries)
    text = F.lower(F.concat_ws(" ", "source", "relation", "target", "evidence"))
    # Equal triples are one text, whose grams are taken once.
    ends = cut(triples.select("source", "target", text.alias("_text")).distinct().withColumn("_id", F.monotonically_increasing_id()))
    hits = substrings.containing(ends, terms, "_id", "_text")
    nodes = ends.join(hits, "_id").select("needle", F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(terms, "needle").select("qid", "node").distinct()


def seeds(triples: DataFrame, queries: DataFrame | None = None, names: DataFrame | None = None, seeding: str = "hybrid", match: str = "exact", aliases: DataFrame | None = None) -> DataFrame:
    """(qid, node) by entity names, by query words, or by both."""
    if seeding not in ("entity_only", "query_only", "hybrid"):
        raise ValueError(f"seeding {seeding!r} is none of entity_only, query_only and hybrid")
    found = []
    if names is not None and seeding != "query_only":
        found.append(seeds_by_name(triples, names, match, aliases))
    if queries is not None and seeding != "entity_only":
        found.append(seeds_by_query(triples, queries))
    if not found:
        raise ValueError("nothing to seed from")
    return reduce(DataFrame.union, found).distinct()


def subgraph(triples: DataFrame, start: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` hops: (qid, node, hop) and (qid, hop, the triple's columns).

    Each hop joins the frontier with sources and with targets, two equi-joins instead of one on
    either, keeps what is new, and cuts the lineage. It ends early when no query finds a new node.
    """
    known = cut(start.select("qid", "node").distinct().withColumn("hop", F.lit(0)))
    ends = triples.select("ord", "source", "target")
    taken = known.select("qid", F.lit(0).cast("long").alias("ord"), "hop").where("false")
    frontier = known
    for hop in range(1, max(depth, 0) + 1):
        at = frontier.select("qid", "node")
        touched = at.join(ends, at["node"] == ends["source"]).select("qid", "ord").union(at.join(ends, at["node"] == ends["target"]).select("qid", "ord")).distinct()
        new_edges = touched.join(taken.select("qid", "ord"), ["qid", "ord"], "left_anti").withColumn("hop", F.lit(hop))
        taken = cut(taken.unionByName(new_edges))
        reached = taken.where(F.col("hop") == hop).join(ends, "ord").select("qid", F.explode(F.array("source", "target")).alias("node")).distinct()
        frontier = cut(reached.join(known.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known, taken.join(triples, "ord")


def ranked_context(edges: DataFrame, hit_chunks: DataFrame, seed_names: DataFrame, most: int = 12) -> DataFrame:
    """(qid, rank, source, relation, target, evidence, source_chunk_id): relations that bear on a query.

    First those read out of its hits (``hit_chunks``: qid, source_chunk_id), then those with a seed
    (``seed_names``: qid, name), then by confidence; of equal triples the first stays.
    """
    hits = hit_chunks.select("qid", "source_chunk_id").distinct().withColumn("in_hit", F.lit(True))
    keys = seed_names.select("qid", tx.entity_key(F.col("name")).alias("key")).distinct().withColumn("seed", F.lit(True))
    rows = edges.join(hits, ["qid", "source_chunk_id"], "left")
    for end in ("source", "target"):
        named = keys.withColumnRenamed("seed", f"seed_{end}")
        rows = rows.withColumn("key", tx.entity_key(F.col(end))).join(named, ["qid", "key"], "left").drop("key")
    has_seed = F.coalesce("seed_source", "seed_target", F.lit(False))
    order = [F.coalesce("in_hit", F.lit(False)).desc(), has_seed.desc(), F.col("confidence").desc_nulls_last(), F.col("hop").asc(), F.col("ord").asc()]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "source", "relation", "target").orderBy(*order))).where("_n = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= most)
    return rows.select("qid", "rank", "source", "relation", "target", "evidence", "source_chunk_id")


def as_text(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, context): numbered lines of each query's edges, or a fixed sentence without any."""
    order = Window.partitionBy("qid").orderBy("hop", "ord")
    lines = F.concat_ws(
        "\n",
        F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target")),
        F.when(F.col("evidence") != "", F.concat(F.lit("   Evidence: "), F.col("evidence"))),
        F.concat(F.lit("   Source: "), F.coalesce("source_chunk_id", F.lit("None"))),
        F.concat(F.lit("   Confidence: "), F.col("confidence").cast("string")),
    )
    numbered = edges.withColumn("_n", F.row_number().over(order)).select("qid", F.struct("_n", lines.alias("line")).alias("x"))
    joined = numbered.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    text = F.coalesce(F.concat(F.lit("Graph evidence:\n"), F.col("body")), F.lit(EMPTY_CONTEXT))
    return queries.select("qid").distinct().join(joined, "qid", "left").select("qid", text.alias("context"))


def parse_triples(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(triples, rejected) from model replies (ord, batch_ids, reply).

    A triple must name one of the batch's chunks; in a batch of one chunk it belongs to that.
    """
    kind = "array<struct<source: string, relation: string, target: string, evidence: string, confidence: string, source_chunk_id: string>>"
    rows = replies.select("ord", "batch_ids", F.posexplode_outer(F.from_json(tx.json_paths(F.col(reply)), kind)).alias("place", "x"))
    named = F.trim(F.regexp_replace(F.coalesce("x.source_chunk_id", F.lit("")), "(?i)^chunk ", ""))
    own = F.when(F.size("batch_ids") == 1, F.get("batch_ids", F.lit(0))).when(F.array_contains("batch_ids", named), named)
    raw = rows.where("x is not null").select((F.shiftleft(F.col("ord").cast("long"), 31) + F.col("place")).alias("ord"), "x.source", "x.relation", "x.target", "x.evidence", "x.confidence", own.alias("source_chunk_id"))
    valid, rejected = validate(raw)
    unknown = valid.where("source_chunk_id is null").withColumn("reason", F.lit("unknown chunk"))
    return valid.where("source_chunk_id is not null"), rejected.unionByName(unknown.withColumn("confidence", F.col("confidence").cast("string")))
