"""Trace, rule, index and file queries. Events stand for agent steps, and conversations for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import actions as ax
from skein.functions import text as tx
from skein.operators import chunking, evaluation, files, incremental, rules, trace
from skein.plans.registry import Catalog
from skein.sources.tables import load
from skein.streaming import sessions as live_sessions
from skein.streaming import usage

catalog = Catalog()

STEPS = """s AS (SELECT user_id AS session_id, event_id AS id, CASE WHEN event_type != 'signup' THEN event_type END AS tool,
  CASE WHEN value < 5 THEN 'deny' WHEN value < 20 THEN 'ask_yes' ELSE 'allow' END AS decision, 'm' || (user_id % 4) AS model, floor(value)::BIGINT AS tokens, ts AS created_at FROM events)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return rows.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("tool"),
        F.when(F.col("value") < 5, "deny").when(F.col("value") < 20, "ask_yes").otherwise("allow").alias("decision"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.floor("value").alias("tokens"), F.col("ts").alias("created_at"),
    )


@catalog.add(f"WITH {STEPS} SELECT tool, decision, count(*) AS calls FROM s WHERE tool IS NOT NULL GROUP BY tool, decision")
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.tool_usage(steps(spark, sf_dir))


LIMITS = "lim AS (SELECT * FROM (VALUES ('m0', 20000::BIGINT, 8000::BIGINT, 6000::BIGINT), ('m1', 0, 4000, NULL), ('m9', 100, 1000, 50)) v(model, cap, context_window, request_tokens))"


def _limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m0", 20000, 8000, 6000), ("m1", 0, 4000, None), ("m9", 100, 1000, 50)], "model string, cap long, context_window long, request_tokens long")


@catalog.add(
    f"""WITH {STEPS}, {LIMITS}, u AS (SELECT model, sum(tokens)::BIGINT AS used FROM s WHERE created_at >= (SELECT max(created_at) FROM s) - INTERVAL 24 HOURS AND model IS NOT NULL GROUP BY model)
SELECT model, coalesce(used, 0) AS used, cap, round(100 * coalesce(used, 0)::DOUBLE / nullif(cap, 0), 1) AS percent FROM u FULL JOIN lim USING (model)"""
)
def token_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    now = rows.agg(F.max("created_at").alias("now"))
    return trace.daily_meter(trace.token_use(rows.crossJoin(now), F.col("now")), _limits(spark).select("model", "cap"))


@catalog.add(
    f"""WITH {STEPS}, {LIMITS}, l AS (SELECT session_id, arg_max(model, id) AS model, arg_max(tokens, id) AS used FROM s WHERE tool IS NOT NULL AND tokens > 0 GROUP BY session_id)
SELECT session_id, l.model, used, least(context_window, request_tokens) AS window, round(100 * used::DOUBLE / least(context_window, request_tokens), 1) AS percent FROM l LEFT JOIN lim USING (model)"""
)
def context_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.context_meter(steps(spark, sf_dir), _limits(spark))


@catalog.add(
    """WITH e AS (SELECT user_id AS session, event_id AS pos, event_type AS action, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS new FROM events),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY session ORDER BY pos)::BIGINT AS run FROM e)
SELECT session, run, any_value(action) AS action, min(pos) AS first, max(pos) AS last, count(*) AS length FROM r GROUP BY session, run"""
)
def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.repeat_runs(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@catalog.add("SELECT user_id, event_id, age::INT AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 12")
def newest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.newest(load(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "age")


@catalog.add("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"))
    return trace.sessions(rows).select(F.col("id").alias("event_id"), F.col("started_at").alias("ts"))


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    nothing = F.lit(None).cast("string")
    tool = F.when(~user, F.when(F.col("turn") % 3 == 1, F.lit("final_answer")).when(F.col("turn") % 3 == 2, "read"))
    args = F.when(tool == "final_answer", F.to_json(F.struct(F.col("text").alias("answer"))))
    return rows.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.lit(1).alias("run"), F.when(user, "user").otherwise("act").alias("step_id"),
        F.when(~user, F.concat(F.lit("m"), (F.col("turn") % 2).cast("string"))).alias("model"), tool.alias("tool"), args.alias("args_json"), F.when(tool == "read", "allow").otherwise(nothing).alias("decision"),
        (F.col("turn") % 5 != 0).alias("ok"), F.when(~user, F.col("text")).alias("model_output"), F.when(user | (tool == "read"), F.col("text")).alias("observation"), F.lit(3).alias("duration_ms"),
        F.length("text").cast("long").alias("tokens"), F.col("turn").alias("created_at"),
    )


@catalog.add(
    """WITH s AS (SELECT conv_id, turn, role = 'user' AS own, length(text) AS n, 'm' || (turn % 2) AS model,
  CASE WHEN role = 'user' THEN 1 WHEN turn % 3 = 0 THEN 1 WHEN trim(text) != '' THEN 2 ELSE 1 END AS parts FROM conversations),
o AS (SELECT *, own OR coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), true) AS opens FROM s),
m AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS message FROM o)
SELECT conv_id AS session_id, message, CASE WHEN bool_or(own) THEN 'user' ELSE 'assistant' END AS role, min(turn) AS time, count(DISTINCT model) FILTER (NOT own) AS n_models,
  sum(n) FILTER (NOT own)::BIGINT AS tokens, sum(parts)::BIGINT AS n_parts FROM m GROUP BY conv_id, message"""
)
def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = trace.transcript(conversation_steps(spark, sf_dir))
    tokens = F.when(F.col("role") == "assistant", F.col("tokens"))
    return messages.select("session_id", "message", "role", "time", F.size("models").cast("long").alias("n_models"), tokens.alias("tokens"), F.size("parts").cast("long").alias("n_parts"))


@catalog.add("SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.turns(trace.transcript(conversation_steps(spark, sf_dir)))


@catalog.add(
    """WITH m AS (SELECT conv_id AS session_id, turn AS id, text, role != 'user' AND length(text) > 600 AS long, length(text) // 3 + 4 AS n,
  array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head FROM conversations),
c AS (SELECT *, left(head, 300) || chr(10) || '[... older output trimmed (' || format('{:,}', length(text)) || ' chars); ask the tool again for the rest]' AS short,
  row_number() OVER (PARTITION BY session_id, long ORDER BY id DESC) AS age, sum(n) OVER (PARTITION BY session_id) AS total FROM m),
t AS (SELECT *, total - coalesce(sum(n - (length(short) // 3 + 4)) FILTER (long AND age > 2) OVER (PARTITION BY session_id), 0) AS t2,
  total - coalesce(sum(n - (length(short) // 3 + 4)) FILTER (long AND age > 1) OVER (PARTITION BY session_id), 0) AS t1 FROM c),
k AS (SELECT *, CASE WHEN t2 <= 1500 THEN 2 WHEN t1 <= 1500 THEN 1 ELSE 0 END AS keep FROM t)
SELECT session_id, id, CASE WHEN long AND age > keep THEN short ELSE text END AS content, long AND age > keep AS cut FROM k"""
)
def trimmed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    messages = rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.when(F.col("role") == "user", "user").otherwise("tool").alias("role"), F.col("text").alias("content"))
    return trace.trimmed(messages, budget=1500).select("session_id", "id", "content", "cut")


@catalog.add(
    """WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS calls, round(avg(x), 6) AS mean, max(x) FILTER (place = n // 2 + 1) AS median, max(x) FILTER (place = floor(0.95 * (n - 1)) + 1) AS p95,
  round(1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS ci95 FROM r GROUP BY event_type"""
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(load(spark, sf_dir, "events"), "event_type", "value")


@catalog.add(
    "SELECT min(value) AS least, (SELECT value FROM events ORDER BY value LIMIT 1 OFFSET (SELECT count(*) // 2 FROM events)) AS median, max(value) AS greatest, count(*) FILTER (value < 0.72) AS below_72, count(*) FILTER (value < 0.75) AS below_75 FROM events"
)
def score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diagnostics(load(spark, sf_dir, "events").select(F.col("value").alias("score")))


RULES = [rules.Rule("p*", "*", "deny"), rules.Rule("*", "rm *", "deny"), rules.Rule("click", "ls*", "allow"), rules.Rule("purchase", "*9*", "ask")]
COMMAND = "CASE event_id % 3 WHEN 0 THEN 'ls -l ' || user_id WHEN 1 THEN 'cat a | rm ' || user_id ELSE 'ls ' || user_id || ' && (echo x; ls y)' END"
LEVEL = "CASE WHEN event_type = 'purchase' AND contains({0}, '9') THEN 2 WHEN event_type = 'click' AND starts_with({0}, 'ls') THEN 1 WHEN starts_with({0}, 'rm ') THEN 3 WHEN starts_with(event_type, 'p') THEN 3 WHEN event_type = 'view' THEN 1 ELSE 2 END"


@catalog.add(
    f"""WITH c AS (SELECT event_id, event_type, {COMMAND} AS cmd FROM events),
p AS (SELECT event_id, event_type, cmd AS part FROM c UNION ALL SELECT event_id, event_type, trim(unnest(string_split_regex(cmd, '&&|\\|\\||\\$\\(|[;|&\\n()`]'))) FROM c),
d AS (SELECT event_id, max({LEVEL.format("part")}) AS level FROM p WHERE part != '' GROUP BY event_id)
SELECT event_id, ['allow', 'ask', 'deny'][level] AS action FROM d"""
)
def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("event_id", rules.decide_call(rules.with_defaults({"view": "allow"}, RULES), F.col("event_type"), F.col("cmd"), F.lit(True)).alias("action"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    first, second = F.concat(F.lit("ls -l "), user), F.concat(F.lit("cat a | rm "), user)
    command = F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise(F.concat(F.lit("ls "), user, F.lit(" && (echo x; ls y)")))
    return load(spark, sf_dir, "events").select("event_id", "event_type", command.alias("cmd"))


@catalog.add(
    f"""WITH c AS (SELECT event_id, {COMMAND} AS cmd FROM events),
w AS (SELECT DISTINCT event_id, regexp_extract(trim(unnest(string_split_regex(cmd, '&&|\\|\\||\\$\\(|[;|&\\n()`]'))), '^\\S+') AS w FROM c)
SELECT event_id, string_agg(w || ', ' || w || ' *', ', ' ORDER BY w) AS scope FROM w WHERE w != '' GROUP BY event_id"""
)
def always_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("event_id", F.array_join(rules.always_scope(F.col("cmd"), F.lit(True)), ", ").alias("scope"))


DISK = """disk AS (SELECT 'n' || doc_id || '.md' AS path, doc_id * 10 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime_ns, length(text) AS size, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 7 != 3),
known AS (SELECT 'n' || doc_id || '.md' AS path, doc_id * 10 AS mtime_ns, length(text) AS size, sha256(text) AS sha FROM documents WHERE doc_id % 11 != 4)"""
STATUS = f"""{DISK}, st AS (SELECT path, CASE WHEN d.sha IS NULL THEN 'removed' WHEN k.sha IS NULL THEN 'added' WHEN (d.mtime_ns = k.mtime_ns AND d.size = k.size) OR d.sha = k.sha THEN 'unchanged' ELSE 'updated' END AS status
  FROM disk d FULL JOIN known k USING (path))"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")))
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    touched = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    disk = rows.where("doc_id % 7 != 3").select("path", (F.col("doc_id") * 10 + touched).alias("mtime_ns"), F.length("text").alias("size"), F.sha2(text, 256).alias("sha"))
    known = rows.where("doc_id % 11 != 4").select("path", (F.col("doc_id") * 10).alias("mtime_ns"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    return disk, known


@catalog.add(f"WITH {STATUS} SELECT path, status FROM st")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff(*_states(spark, sf_dir))


@catalog.add(f"WITH {STATUS} SELECT {', '.join(f'''count(*) FILTER (status = '{x}') AS {x}''' for x in ('added', 'updated', 'removed', 'unchanged'))} FROM st")
def index_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.counts(index_diff(spark, sf_dir))


CHUNKS = """c AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'ab' END || '/n' || conv_id || '.md' AS path, coalesce(role, '') AS heading, turn::INT AS ord, text FROM conversations),
ch AS (SELECT substr(sha1(path || chr(0) || heading || chr(0) || text), 1, 16) AS id, path, ord FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    folder = F.when(F.col("conv_id") % 2 == 0, "a").otherwise("ab")
    rows = rows.select(F.concat(folder, F.lit("/n"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("role", F.lit("")).alias("heading"), F.col("turn").cast("int").alias("ord"), F.lit(1).alias("line"), "text")
    return rows.withColumn("id", tx.chunk_id(F.col("path"), F.col("heading"), F.col("text"))).withColumn("vec", F.array(F.col("ord").cast("float")))


@catalog.add(f"WITH {CHUNKS} SELECT id, path, ord FROM ch WHERE NOT starts_with(path, 'a/')")
def index_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.remove(_chunks(spark, sf_dir), "a").select("id", "path", "ord")


@catalog.add(
    f"""WITH {CHUNKS}, m AS (SELECT CASE WHEN starts_with(path, 'a/') THEN 'moved/deep' || substr(path, 2) ELSE path END AS path, heading, ord, text FROM c)
SELECT substr(sha1(path || chr(0) || heading || chr(0) || text), 1, 16) AS id, path, ord, ord::DOUBLE AS vec FROM m"""
)
def index_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.move(_chunks(spark, sf_dir), "a", "moved/deep").select("id", "path", "ord", F.get("vec", F.lit(0)).cast("double").alias("vec"))


@catalog.add(
    f"""WITH {CHUNKS}, f AS (SELECT path, heading, ord, CASE WHEN ord % 2 = 0 THEN text || '+' ELSE text END AS text FROM c WHERE starts_with(path, 'a/')),
o AS (SELECT substr(sha1(path || chr(0) || heading || chr(0) || text), 1, 16) AS id, path, ord, CASE WHEN ord % 2 = 0 THEN -1.0::DOUBLE ELSE ord::DOUBLE END AS vec FROM f)
SELECT * FROM o UNION ALL SELECT id, path, ord, ord::DOUBLE FROM ch WHERE NOT starts_with(path, 'a/')"""
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second section of the notes under ``a`` was edited; the others keep their vectors."""
    chunks = _chunks(spark, sf_dir)
    fresh = chunks.where("path like 'a/%'").withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")))
    fresh = fresh.withColumn("id", tx.chunk_id(F.col("path"), F.col("heading"), F.col("text"))).drop("vec")
    after = incremental.upsert(chunks, fresh, lambda df: df.withColumn("vec", F.array(F.lit(-1.0).cast("float"))))
    return after.select("id", "path", "ord", F.get("vec", F.lit(0)).cast("double").alias("vec"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    return rows.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))).alias("path"), "text")


FILES = "f AS (SELECT source || '/' || lang || '/d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS path, text FROM documents)"


@catalog.add(
    f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM f)
SELECT path, line::INT AS line, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) AS text FROM l WHERE regexp_matches(text, '[Ll]icen[cs]ed? under|@')"""
)
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.grep(_files(spark, sf_dir), "[Ll]icen[cs]ed? under|@", limit=None)


@catalog.add(f"WITH {FILES} SELECT path FROM f WHERE regexp_matches(path, '^src1.*/en/d.5.*\\.md$') ORDER BY path LIMIT 100")
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.find(_files(spark, sf_dir), "src1*/en/d?5*.md")


@catalog.add(
    f"""WITH {FILES}, p AS (SELECT string_split(path, '/') AS x FROM f)
SELECT '' AS parent, x[1] AS name, 'folder' AS kind, NULL::BIGINT AS items FROM p GROUP BY ALL UNION ALL SELECT x[1], x[2], 'folder', count(DISTINCT x[3]) FROM p GROUP BY x[1], x[2]"""
)
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tree(_files(spark, sf_dir), 2)


def _nested_sql(levels: int) -> str:
    node = lambda name, path, kind: f"'{{\"name\":' || to_json({name}) || ',\"path\":' || to_json({path}) || ',\"type\":\"{kind}\"'"
    out = [f"e AS (SELECT source AS root, path, string_split(path, '/') AS x, {node('list_last(x)', 'path', 'file')} || ',\"size\":' || n_chars || '}}' AS json FROM f)", f"n{levels} AS (SELECT root, x, 1 AS kind, json FROM e WHERE len(x) = {levels})"]
    for k in range(levels, 0, -1):
        path = f"array_to_string(x[1:{k - 1}], '/')"
        out.append(f"""g{k} AS (SELECT root, x[1:{k - 1}] AS x, string_agg(json, ',' ORDER BY kind, lower(list_last(x)), list_last(x)) AS inside FROM n{k} GROUP BY root, x[1:{k - 1}])""")
        name = "root" if k == 1 else "list_last(x)"
        below = f" UNION ALL SELECT root, x, 1, json FROM e WHERE len(x) = {k - 1}" if k > 1 else ""
        out.append(f"""n{k - 1} AS (SELECT root, x, 0 AS kind, {node(name, path, 'folder')} || ',\"children\":[' || inside || ']}}' AS json FROM g{k}{below})""")
    return ",\n".join(out)


@catalog.add(
    f"""WITH f AS (SELECT source, n_chars, CASE WHEN doc_id < 10 THEN '' ELSE array_to_string(string_split((doc_id // 10)::VARCHAR, ''), '/') || '/' END || 'N' || doc_id % 10 || '.md' AS path FROM documents),
{_nested_sql(8)} SELECT root, json AS tree FROM n0"""
)
def nested_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree a source, of the documents in folders named by the digits of their ids."""
    docs = load(spark, sf_dir, "documents")
    folders = F.array_join(F.split(F.floor(F.col("doc_id") / 10).cast("string"), ""), "/")
    path = F.concat(F.when(F.col("doc_id") < 10, "").otherwise(F.concat(folders, F.lit("/"))), F.lit("N"), (F.col("doc_id") % 10).cast("string"), F.lit(".md"))
    return files.nested_tree(docs.select(F.col("source").alias("root"), path.alias("path"), F.col("n_chars").alias("size")))


@catalog.add("SELECT source AS file, sum(length(text))::BIGINT // 4 AS tokens, CASE WHEN sum(length(text))::BIGINT // 4 <= 25000 THEN 'full text' ELSE 'index' END AS route FROM documents GROUP BY source")
def attach_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text")
    return files.attach_policy(pages, 25_000)


@catalog.add(
    """WITH h AS (SELECT source AS file, doc_id AS place, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents),
s AS (SELECT *, (c + 14) // 15 AS step FROM h) SELECT file, place, md5(text) AS digest FROM s WHERE (n - 1) % step = 0 AND (n - 1) // step < 15"""
)
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("place"), "text")
    return files.outline(rows).select("file", "place", F.md5("text").alias("digest"))


@catalog.add(
    "SELECT source AS workspace, doc_id AS path, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 20000 AS whole FROM documents"
)
def snapshot_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.col("doc_id").alias("path"), "text")
    return files.snapshot(rows, 20_000).select("workspace", "path", "whole")


@catalog.add(
    """SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 AS found, CASE WHEN NOT contains(text, 'the ') THEN 'the text was not found' END AS error, md5(replace(text, 'the ', 'THE ')) AS edited FROM documents"""
)
def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = files.replace_text(F.col("text"), "the ", "THE ", every=True)
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", edit.alias("edit"))
    found = ((F.length("text") - F.length(F.replace("text", F.lit("the "), F.lit("")))) / 4).cast("long")
    return rows.select("doc_id", found.alias("found"), "edit.error", F.md5(F.coalesce("edit.text", "text")).alias("edited"))


@catalog.add("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'read' WHEN turn % 4 = 1 THEN 'grep' WHEN turn % 4 = 2 THEN 'write' END AS tool, turn % 4 = 3 AS failed FROM conversations")
def parsed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of a turn's text and a call in one of three notations, or none."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[{}<`]", "").alias("text"))
    call = F.when(F.col("turn") % 4 == 0, F.lit('```json\n{"tool": "read", "args": {"path": "a"}}\n```')).when(F.col("turn") % 4 == 1, F.lit('so {"tool": "grep", "pattern": "x"} it is'))
    call = call.when(F.col("turn") % 4 == 2, F.lit("<tool_call><function=write><parameter=path>a</parameter></tool_call>")).otherwise("")
    parsed = rows.select("conv_id", "turn", ax.action(F.concat("text", F.lit("\n"), call)).alias("x"))
    return parsed.select("conv_id", "turn", "x.tool", F.col("x.error").isNotNull().alias("failed"))


@catalog.add(
    """WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, conv_id, turn, length(text) AS n FROM conversations),
t AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM r) SELECT conv_id, turn, upto::BIGINT AS upto FROM t"""
)
def running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    window = trace.Window.partitionBy("conv_id").orderBy("turn")
    return rows.select("conv_id", "turn", F.sum(F.length("text")).over(window).alias("upto"))


@catalog.add(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations),
o AS (SELECT conv_id, turn, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM r),
b AS (SELECT conv_id, turn, n, i, n AS total, 0 AS batch FROM o WHERE i = 1 UNION ALL
  SELECT o.conv_id, o.turn, o.n, o.i, CASE WHEN b.total > 0 AND b.total + o.n > 2000 THEN o.n ELSE b.total + o.n END, b.batch + CASE WHEN b.total > 0 AND b.total + o.n > 2000 THEN 1 ELSE 0 END
  FROM b JOIN o ON o.conv_id = b.conv_id AND o.i = b.i + 1)
SELECT conv_id, turn, n, batch FROM b"""
)
def extraction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return chunking.greedy_batches(rows, "n", 2000, ["turn"], ["conv_id"]).select("conv_id", "turn", "n", "batch")


@catalog.add("SELECT event_type, count(*) AS calls FROM events GROUP BY event_type")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, drained: the same counts as in one batch."""
    stream = usage.events(spark, f"{sf_dir}/events.parquet*")
    return usage.drain(usage.usage(stream, ["event_type"]), "stream_usage")


@catalog.add(
    "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL"
)
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows with a watermark, drained from a stream."""
    daily = usage.windowed(usage.events(spark, f"{sf_dir}/events.parquet*"), "event_type")
    return usage.drain(daily, "stream_daily").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "calls", F.round("total", 4).alias("total"))


_STEPS = """SELECT user_id::VARCHAR AS session, event_id AS "at", event_type AS tool, event_id % 3 AS scope, ['ask', 'ask', 'allow', 'deny'][event_id % 4 + 1] AS rule, ['no', 'allow', 'always'][event_id % 7 % 3 + 1] AS reply FROM events"""


@catalog.add(
    f"""WITH e AS ({_STEPS}), g AS (SELECT session, tool, scope, min("at") AS since FROM e WHERE rule = 'ask' AND reply = 'always' GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(tool) OVER w = tool AND lag(scope) OVER w = scope THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY session ORDER BY "at")),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY "at") AS run FROM n)
SELECT session, "at", CASE WHEN rule != 'ask' THEN rule WHEN "at" > since THEN 'allow' WHEN "at" = since THEN 'ask_always' WHEN reply = 'allow' THEN 'ask_yes' ELSE 'ask_no' END AS decision,
  row_number() OVER (PARTITION BY session, run ORDER BY "at") - 1 AS repeats FROM r LEFT JOIN g USING (session, tool, scope)"""
)
def stream_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of tool calls with rules and replies: what was decided, with state per session.

    The table's files are in no order of time, so they come in one batch, where none is late and no session expires.
    """
    pick = lambda n, *words: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    n = F.col("event_id")
    steps = usage.events(spark, f"{sf_dir}/events.parquet*", files_per_batch=2**31 - 1).select(
        F.col("user_id").alias("session"), n.alias("at"), "ts", F.col("event_type").alias("tool"), (n % 3).cast("string").alias("scope"), pick(n % 4, "ask", "ask", "allow", "deny").alias("rule"),
        pick(n % 7 % 3, "no", "allow", "always").alias("reply"), n.cast("string").alias("note"),
    )
    return live_sessions.land(live_sessions.follow(steps)).where("kind = 'step'").select("session", "at", "decision", "repeats")
