"""What agents did and at what cost: usage, meters, transcripts, runs of repeated actions.

``steps`` is (session_id, id, run, step_id, model, tool, args_json, decision, ok, model_output,
observation, duration_ms, tokens, created_at); rows with step_id ``user`` or ``hint`` are messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx

HISTORY = 12
KEEP_WHOLE, SHORT_ABOVE = 2, 600


def tool_usage(steps: DataFrame) -> DataFrame:
    """(tool, decision, calls)."""
    return steps.where("tool is not null").groupBy("tool", "decision").agg(F.count("*").alias("calls"))


def token_use(steps: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(model, used): tokens of each model in the hours up to ``now``."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return steps.where((F.col("created_at") >= since) & F.col("model").isNotNull()).groupBy("model").agg(F.sum("tokens").alias("used"))


def daily_meter(used: DataFrame, limits: DataFrame) -> DataFrame:
    """(model, used, cap, percent) of models with a limit (model, cap) or with use."""
    both = used.join(limits, "model", "full_outer").select("model", F.coalesce("used", F.lit(0)).alias("used"), "cap")
    return both.withColumn("percent", F.round(100 * F.col("used") / F.nullif("cap", F.lit(0)), 1))


def context_meter(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """(session_id, model, used, window, percent) of each session's last tool step with tokens.

    The window is the smallest known of ``context_window`` and ``request_tokens``.
    """
    last = steps.where("tool is not null and tokens > 0").groupBy("session_id").agg(F.max_by(F.struct("model", "tokens"), "id").alias("x"))
    rows = last.select("session_id", "x.model", F.col("x.tokens").alias("used")).join(limits, "model", "left")
    window = F.least("context_window", "request_tokens")
    return rows.select("session_id", "model", "used", window.alias("window"), F.round(100 * F.col("used") / window, 1).alias("percent"))


def sessions(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def find_session(rows: DataFrame, text: str) -> str:
    """The id that is ``text``, or else the only one that contains it."""
    found = [r["id"] for r in rows.where(F.col("id").contains(text)).select("id").orderBy(F.col("id") != text, "id").limit(6).collect()]
    if text in found:
        return text
    if len(found) == 1:
        return found[0]
    raise ValueError(f"no session matches '{text}'" if not found else f"'{text}' matches several sessions: {', '.join(found[:5])}")


def args(steps: DataFrame) -> DataFrame:
    """``steps`` with ``args``: the parsed arguments, or null where the text was cut off."""
    return steps.withColumn("args", F.try_parse_json("args_json"))


def parts() -> Column:
    """The parts of an assistant message that a step makes, in order: (type, text, tool, status, decision)."""
    nothing = F.lit(None).cast("string")
    fields = ("type", "text", "tool", "status", "decision")
    part = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, fields, strict=True)))
    ok = F.coalesce("ok", F.lit(True))
    words = tx.without_action(F.col("model_output"))
    status = F.when(ok, "completed").when(F.col("decision").isin("deny", "ask_no"), "denied").otherwise("error")
    verdict = part(F.when(ok, "review").otherwise("error"), F.when(ok, F.col("model_output")).otherwise(F.col("observation")), nothing, nothing, nothing)
    answer = part(F.lit("text"), F.coalesce(F.get_json_object("args_json", "$.answer"), F.lit("")), nothing, nothing, nothing)
    call = part(F.lit("tool"), F.col("observation"), F.col("tool"), status, F.col("decision"))
    reasoning = F.when(F.col("tool").isNotNull() & (words != ""), part(F.lit("reasoning"), words, nothing, nothing, nothing))
    outcome = F.when(F.col("tool").isNull(), verdict).when(F.col("tool") == "final_answer", answer).otherwise(call)
    is_message = F.coalesce(F.col("step_id").isin("user", "hint"), F.lit(False))
    return F.when(is_message, F.array().cast("array<struct<type:string,text:string,tool:string,status:string,decision:string>>")).otherwise(F.array_compact(F.array(reasoning, outcome)))


def transcript(steps: DataFrame) -> DataFrame:
    """(session_id, message, role, kind, time, models, tokens, parts): steps folded into messages.

    A user or hint row is a message and closes the assistant message before it.
    """
    own = F.coalesce(F.col("step_id").isin("user", "hint"), F.lit(False))
    order = Window.partitionBy("session_id").orderBy("id")
    opens = own | F.coalesce(F.lag("_own").over(order), F.lit(True))
    rows = steps.withColumn("_own", own).withColumn("_open", opens.cast("int")).withColumn("message", F.sum("_open").over(order))
    said = F.array(F.struct(F.lit("text").alias("type"), F.col("observation").alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("tool", "status", "decision"))))
    rows = rows.withColumn("_parts", F.when(F.col("_own"), said).otherwise(parts()))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", F.when(~F.col("_own"), F.col("model")).alias("model"), "_parts"))), lambda x: x)
    folded = rows.groupBy("session_id", "message").agg(
        F.first("_own").alias("_own"), F.min_by("step_id", "id").alias("step_id"), F.min_by("created_at", "id").alias("time"), F.sum(F.when(~F.col("_own"), F.coalesce("tokens", F.lit(0)))).alias("tokens"), listed.alias("_rows")
    )
    return folded.select(
        "session_id",
        "message",
        F.when(F.col("_own"), "user").otherwise("assistant").alias("role"),
        F.when(F.col("step_id") == "hint", "hint").when(F.col("_own"), "message").alias("kind"),
        "time",
        F.array_distinct(F.array_compact(F.transform("_rows", lambda x: x["model"]))).alias("models"),
        "tokens",
        F.flatten(F.transform("_rows", lambda x: x["_parts"])).alias("parts"),
    )


def turns(messages: DataFrame) -> DataFrame:
    """(session_id, turns): the user messages of each session, hints aside."""
    return messages.groupBy("session_id").agg(F.count_if(F.col("kind") == "message").alias("turns"))


def repeat_runs(rows: DataFrame, session: str, order: str, action: str) -> DataFrame:
    """(session, run, action, first, last, length): consecutive equal actions of a session."""
    by = Window.partitionBy(session).orderBy(order)
    new = F.coalesce((~F.col(action).eqNullSafe(F.lag(action).over(by))).cast("int"), F.lit(1))
    marked = rows.select(F.col(session).alias("session"), F.col(order).alias("at"), F.col(action).alias("action"), new.alias("_new"))
    marked = marked.withColumn("run", F.sum("_new").over(Window.partitionBy("session").orderBy("at")))
    return marked.groupBy("session", "run").agg(F.first("action").alias("action"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("length"))


def newest(rows: DataFrame, session: str, order: str, most: int = HISTORY) -> DataFrame:
    """The last ``most`` rows of each session, with ``age`` from 1 for the newest."""
    age = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return rows.withColumn("age", age).where(F.col("age") <= most)


def trimmed(messages: DataFrame, budget: int | None = None, keep: int = KEEP_WHOLE) -> DataFrame:
    """``messages`` (session_id, id, role, content) with long tool output shortened, and ``cut``.

    All but the newest ``keep`` long outputs of a session are shortened; where the estimate of tokens
    is still over ``budget``, one more is, until it fits or none is whole. The sizes after each step
    are running sums, so no loop over messages is needed.
    """
    mark = "[... older output trimmed"  # a fixed value: agents look for it
    long = (F.length("content") > SHORT_ABOVE) & ~F.col("content").contains(mark) & ((F.col("role") == "tool") | ((F.col("role") == "user") & F.col("content").startswith("Observation:")))
    head = F.left(F.array_join(F.slice(F.split("content", "\r\n|\n|\r"), 1, 2), "\n"), F.lit(300))
    short = F.concat(head, F.lit(f"\n{mark} ("), F.format_number(F.length("content"), 0), F.lit(" chars); ask the tool again for the rest]"))
    rows = messages.withColumn("_long", F.coalesce(long, F.lit(False))).withColumn("_short", F.when(F.col("_long"), short))
    age = F.row_number().over(Window.partitionBy("session_id", "_long").orderBy(F.desc("id")))
    rows = rows.withColumn("_age", F.when(F.col("_long"), age))
    whole = Window.partitionBy("session_id")
    saved = F.when(F.col("_long"), tx.message_tokens(F.col("content")) - tx.message_tokens(F.col("_short"))).otherwise(0)
    rows = rows.withColumn("_total", F.sum(tx.message_tokens(F.col("content"))).over(whole)).withColumn("_saved", saved)
    after = lambda n: F.col("_total") - F.coalesce(F.sum(F.when(F.col("_age") > n, F.col("_saved"))).over(whole), F.lit(0))
    left = F.lit(0)
    for n in range(keep + 1):
        left = F.when(after(n) <= budget, n).otherwise(left) if budget is not None else F.lit(keep)
    rows = rows.withColumn("_keep", left).withColumn("cut", F.coalesce(F.col("_age") > F.col("_keep"), F.lit(False)))
    return rows.withColumn("content", F.when(F.col("cut"), F.col("_short")).otherwise(F.col("content"))).select(*messages.columns, "cut")
