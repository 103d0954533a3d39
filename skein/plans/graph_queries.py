"""Knowledge-graph and notes queries.

The graph of customers, nations and regions stands for extracted triples, and the turns of
conversations for sections of notes that link to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import knowledge, notes
from skein.plans.registry import Catalog
from skein.sources.tables import load

catalog = Catalog()
REGIONS_FROM = 1_000_000_000_000

TRIPLES = f"""t AS (
SELECT c_custkey::BIGINT AS ord, c_name AS source, 'lives in' AS relation, n_name AS target, 'customer ' || c_custkey || ' of segment ' || c_mktsegment AS evidence,
       (c_custkey % 10) / 10.0::DOUBLE AS confidence, 'c' || (c_custkey % 7) AS source_chunk_id FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT {REGIONS_FROM} + n_nationkey, n_name, 'part of', r_name, '', 0.5, 'r' || r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    customer = load(spark, sf_dir, "customer")
    homes = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("source"), F.lit("lives in").alias("relation"), F.col("n_name").alias("target"),
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string"), F.lit(" of segment "), "c_mktsegment").alias("evidence"),
        ((F.col("c_custkey") % 10) / 10).alias("confidence"), F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string")).alias("source_chunk_id"),
    )
    parts = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        (REGIONS_FROM + F.col("n_nationkey")).cast("long").alias("ord"), F.col("n_name"), F.lit("part of"), F.col("r_name"), F.lit(""), F.lit(0.5), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    )
    return homes.union(parts)


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "ASIA"), (1, "no such place"), (2, "Customer#000000007"), (3, "the-AFRICA")], "qid long, name string")


STARTS = "n0 AS (SELECT * FROM (VALUES (1::BIGINT, 'ASIA'), (2, 'Customer#000000007'), (3, 'AFRICA')) v(qid, node))"
HOPS = f"""{TRIPLES}, {STARTS},
e1 AS (SELECT DISTINCT qid, ord FROM n0 JOIN t ON node = source OR node = target),
n1 AS (SELECT DISTINCT qid, unnest([source, target]) AS node FROM e1 JOIN t USING (ord)),
e2 AS (SELECT DISTINCT qid, ord FROM n1 JOIN t ON node = source OR node = target),
n2 AS (SELECT DISTINCT qid, unnest([source, target]) AS node FROM e2 JOIN t USING (ord)),
nodes AS (SELECT qid, node, min(hop)::INT AS hop FROM (SELECT *, 0 AS hop FROM n0 UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2) GROUP BY qid, node),
edges AS (SELECT qid, ord, min(hop)::INT AS hop FROM (SELECT *, 1 AS hop FROM e1 UNION ALL SELECT *, 2 FROM e2) GROUP BY qid, ord)"""


def _subgraph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = triples(spark, sf_dir)
    return knowledge.subgraph(rows, knowledge.seeds(rows, names=_starts(spark), seeding="entity_only", match="normalized"), 2)


@catalog.add(f"WITH {HOPS} SELECT qid, node, hop FROM nodes")
def kg_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgraph(spark, sf_dir)[0]


@catalog.add(f"WITH {HOPS} SELECT qid, hop, ord, source, relation, target FROM edges JOIN t USING (ord)")
def kg_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgraph(spark, sf_dir)[1].select("qid", "hop", "ord", "source", "relation", "target")


@catalog.add(
    f"""WITH {HOPS}, h AS (SELECT qid, ord, source, relation, target, evidence, confidence, hop, source_chunk_id, source_chunk_id IN ('c3', 'r2') AS in_hit,
  (qid = 1 AND (source = 'ASIA' OR target = 'ASIA')) OR (qid = 2 AND source = 'Customer#000000007') OR (qid = 3 AND (source = 'AFRICA' OR target = 'AFRICA')) AS seed FROM edges JOIN t USING (ord)),
u AS (SELECT *, row_number() OVER (PARTITION BY qid, source, relation, target ORDER BY in_hit DESC, seed DESC, confidence DESC, hop, ord) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY in_hit DESC, seed DESC, confidence DESC, hop, ord) AS rank FROM u WHERE n = 1)
SELECT qid, rank::INT AS rank, source, relation, target, evidence, source_chunk_id FROM r WHERE rank <= 12"""
)
def kg_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(q, c) for q in (1, 2, 3) for c in ("c3", "r2")], "qid long, source_chunk_id string")
    return knowledge.ranked_context(_subgraph(spark, sf_dir)[1], hits, _starts(spark))


@catalog.add(
    f"""WITH {HOPS}, l AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY hop, ord) AS n, source, relation, target, evidence, confidence, source_chunk_id FROM edges JOIN t USING (ord) WHERE hop = 1)
SELECT qid, 'Graph evidence:' || chr(10) || string_agg(n || '. ' || source || ' --' || relation || '--> ' || target || CASE WHEN evidence != '' THEN chr(10) || '   Evidence: ' || evidence ELSE '' END
  || chr(10) || '   Source: ' || source_chunk_id || chr(10) || '   Confidence: ' || confidence, chr(10) ORDER BY n) AS context FROM l GROUP BY qid"""
)
def kg_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.as_text(_subgraph(spark, sf_dir)[1].where("hop = 1"), _starts(spark))


@catalog.add(
    f"""WITH {TRIPLES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 'customers of the MACHINERY segment'), (2, 'who is part of AFRICA'), (3, 'a b')) v(qid, text)),
w AS (SELECT DISTINCT qid, CASE WHEN length(w) >= 5 THEN left(w, 5) ELSE w END AS needle FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM q)
      WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{x}'" for x in knowledge.STOPWORDS)}))
SELECT DISTINCT qid, unnest([source, target]) AS node FROM w JOIN t ON contains(lower(source || ' ' || relation || ' ' || target || ' ' || evidence), needle)"""
)
def kg_query_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "customers of the MACHINERY segment"), (2, "who is part of AFRICA"), (3, "a b")], "qid long, text string")
    return knowledge.seeds_by_query(triples(spark, sf_dir), asked)


VARIED = f"""{TRIPLES}, v AS (SELECT ord, CASE ord % 3 WHEN 0 THEN source WHEN 1 THEN 'the ' || lower(source) ELSE upper(source) END AS source,
  CASE ord % 4 WHEN 0 THEN 'The ' || target WHEN 1 THEN lower(target) WHEN 2 THEN '  a ' || replace(target, '_', '-') ELSE target END AS target FROM t),
m AS (SELECT ord, unnest([0, 1]) AS place, trim(regexp_replace(unnest([source, target]), '\\s+', ' ', 'g')) AS label FROM v),
k AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(replace(label, '-', ' '), '\\s+', ' ', 'g'))), '^(the|an|a) ', '')) AS key FROM m),
b AS (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY regexp_matches(lower(label), '^(the|a|an) ')::INT, -len(list_filter(string_split(label, ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}'))), -length(label), ord, place) AS n FROM k),
c AS (SELECT key, CASE WHEN trim(regexp_replace(label, '^(?i)(the|a|an) ', '')) != '' THEN trim(regexp_replace(label, '^(?i)(the|a|an) ', '')) ELSE label END AS label FROM b WHERE n = 1)"""


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    s, t = F.col("source"), F.col("target")
    source = F.when(F.col("ord") % 3 == 0, s).when(F.col("ord") % 3 == 1, F.concat(F.lit("the "), F.lower(s))).otherwise(F.upper(s))
    target = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("The "), t)).when(F.col("ord") % 4 == 1, F.lower(t)).when(F.col("ord") % 4 == 2, F.concat(F.lit("  a "), F.replace(t, F.lit("_"), F.lit("-")))).otherwise(t)
    return rows.withColumn("source", source).withColumn("target", target)


@catalog.add(f"WITH {VARIED} SELECT key, label FROM c")
def kg_canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.canonical_labels(_varied(spark, sf_dir))


@catalog.add(
    f"""WITH {VARIED} SELECT v.ord, a.label AS source, b.label AS target FROM v JOIN k ks ON ks.ord = v.ord AND ks.place = 0 JOIN c a ON a.key = ks.key
JOIN k kt ON kt.ord = v.ord AND kt.place = 1 JOIN c b ON b.key = kt.key"""
)
def kg_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.normalize(_varied(spark, sf_dir)).select("ord", "source", "target")


@catalog.add(f"WITH {VARIED} SELECT c.label, array_to_string(list_sort(list(DISTINCT k.label)), ' / ') AS variants FROM k JOIN c USING (key) WHERE k.label != c.label GROUP BY c.label")
def kg_alias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.alias_report(_varied(spark, sf_dir)).select("label", F.array_join("variants", " / ").alias("variants"))


@catalog.add(
    f"""WITH {TRIPLES}, r AS (SELECT CASE WHEN ord % 11 = 0 THEN '  ' ELSE source END AS source, CASE WHEN ord % 13 = 0 THEN NULL ELSE relation END AS relation, CASE WHEN ord % 17 = 0 THEN '' ELSE target END AS target,
  CASE WHEN ord % 19 = 0 THEN 'high' ELSE '0.7' END AS confidence FROM t),
x AS (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN '''source'' must be a non-empty string' WHEN relation IS NULL THEN '''relation'' must be a non-empty string'
  WHEN target = '' THEN '''target'' must be a non-empty string' WHEN confidence = 'high' THEN '''confidence'' must be numeric' ELSE 'valid' END AS reason FROM r)
SELECT reason, count(*) AS n FROM x GROUP BY reason"""
)
def kg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    every = lambda n: F.col("ord") % n == 0
    raw = rows.withColumns(
        {"source": F.when(every(11), "  ").otherwise(F.col("source")), "relation": F.when(~every(13), F.col("relation")), "target": F.when(every(17), "").otherwise(F.col("target")), "confidence": F.when(every(19), "high").otherwise("0.7")}
    )
    valid, rejected = knowledge.validate(raw)
    return valid.select(F.lit("valid").alias("reason")).union(rejected.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


LINKS_TO = 60
SECTIONS = f"""s AS (SELECT 'team' || (conv_id % 5) || '/note' || conv_id || '.md' AS path, coalesce(role, '') AS heading, turn::INT AS ord, (turn * 100 + 1)::INT AS line,
  text || chr(10) || 'see [[' || CASE WHEN turn % 3 = 0 THEN 'team' || ((conv_id * 7 + turn) % 5) || '/' ELSE '' END || 'Note' || ((conv_id * 7 + turn) % {LINKS_TO}) || '|that]] and [[nothing]]' AS text FROM conversations),
sec AS (SELECT *, substr(sha1(path || chr(0) || heading || chr(0) || text), 1, 16) AS id, substr(sha1(heading || chr(0) || text), 1, 16) AS key FROM s),
f AS (SELECT DISTINCT path FROM s)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    to = (F.col("conv_id") * 7 + F.col("turn")) % LINKS_TO
    folder = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("team"), ((F.col("conv_id") * 7 + F.col("turn")) % 5).cast("string"), F.lit("/"))).otherwise("")
    rows = turns.select(
        F.concat(F.lit("team"), (F.col("conv_id") % 5).cast("string"), F.lit("/note"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        F.coalesce("role", F.lit("")).alias("heading"), F.col("turn").cast("int").alias("ord"), (F.col("turn") * 100 + 1).cast("int").alias("line"),
        F.concat("text", F.lit("\nsee [["), folder, F.lit("Note"), to.cast("string"), F.lit("|that]] and [[nothing]]")).alias("text"),
    )
    return rows.withColumn("id", tx.chunk_id(F.col("path"), F.col("heading"), F.col("text"))).withColumn("key", tx.section_key(F.col("heading"), F.col("text")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("path").distinct()


LINKS = rf"""{SECTIONS},
lines AS (SELECT path, ord, line, unnest(string_split(text, chr(10))) AS row, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS offs FROM sec),
raw AS (SELECT path, ord, line + offs AS line, trim(row) AS row, trim(unnest(regexp_extract_all(row, '{tx.WIKILINK}', 1))) AS name FROM lines),
cand AS (SELECT raw.*, f.path AS target, row_number() OVER (PARTITION BY raw.path, ord, line, name ORDER BY
   CASE WHEN contains(name, '/') AND ends_with(regexp_replace(lower(f.path), '\.md$', ''), lower(name)) THEN 0 ELSE 1 END,
   CASE WHEN starts_with(f.path, regexp_replace(raw.path, '/[^/]*$', '') || '/') THEN 0 ELSE 1 END, length(f.path), f.path) AS n
   FROM raw JOIN f ON regexp_replace(regexp_extract(f.path, '[^/]*$'), '\.md$', '') = lower(regexp_extract(name, '[^/]*$'))),
link AS (SELECT path AS source, target, line::INT AS line, left(row, 200) AS text, row_number() OVER (PARTITION BY path ORDER BY ord, line)::INT AS place FROM cand WHERE n = 1)"""


@catalog.add(f"WITH {LINKS} SELECT * FROM link")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.links(sections(spark, sf_dir), _files(spark, sf_dir))


@catalog.add(f"WITH {LINKS} SELECT target, source AS path, line, text FROM link WHERE source != target")
def note_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.backlinks(note_links(spark, sf_dir))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).where("ord % 2 = 0").select("key")


@catalog.add(f"WITH {SECTIONS} SELECT id, path, ord, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path, ord) AS n FROM sec WHERE key NOT IN (SELECT key FROM sec WHERE ord % 2 = 0)) WHERE n = 1")
def notes_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.pending(sections(spark, sf_dir), _extracted(spark, sf_dir)).select("id", "path", "ord", "key")


@catalog.add(
    f"""WITH {SECTIONS}, e AS (SELECT DISTINCT key FROM sec WHERE ord % 2 = 0)
SELECT count(*) AS chunks, count(DISTINCT key) FILTER (key IN (SELECT key FROM e)) AS extracted, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM e)) AS pending FROM sec WHERE starts_with(path, 'team1/')"""
)
def notes_extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.extraction_stats(sections(spark, sf_dir), _extracted(spark, sf_dir), "team1")


FACTS = f"""{LINKS}, fact AS (SELECT path, 'Role ' || heading AS source, 'speaks in' AS relation, 'Team ' || (ord % 4) AS target, 'turn ' || ord AS evidence FROM sec),
ed AS (SELECT 'note:' || source AS source, 'note:' || target AS target, 'link' AS kind, NULL AS label FROM link
  UNION SELECT 'entity:' || source, 'entity:' || target, 'relation', relation FROM fact
  UNION SELECT 'note:' || path, 'entity:' || unnest([source, target]), 'mention', NULL FROM fact)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir)
    triples_ = rows.select(
        F.xxhash64("id").alias("ord"), "key", F.concat(F.lit("Role "), "heading").alias("source"), F.lit("speaks in").alias("relation"), F.concat(F.lit("Team "), (F.col("ord") % 4).cast("string")).alias("target"),
        F.concat(F.lit("turn "), F.col("ord").cast("string")).alias("evidence"), F.lit(0.5).alias("confidence"),
    ).dropDuplicates(["key"])
    return notes.facts(sections(spark, sf_dir), triples_)


@catalog.add(f"WITH {FACTS} SELECT source, target, kind, label FROM ed")
def notes_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.view(sections(spark, sf_dir), note_links(spark, sf_dir), _facts(spark, sf_dir))[1].select("source", "target", "kind", "label")


@catalog.add(
    f"""WITH {FACTS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM ed) GROUP BY id),
n AS (SELECT 'note:' || path AS id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS label, 'note' AS kind FROM f UNION SELECT 'entity:' || e, e, 'entity' FROM (SELECT unnest([source, target]) AS e FROM fact))
SELECT id, label, kind, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (id)"""
)
def notes_view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.view(sections(spark, sf_dir), note_links(spark, sf_dir), _facts(spark, sf_dir))[0].select("id", "label", "kind", "degree")
