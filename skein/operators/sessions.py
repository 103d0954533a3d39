"""Sessions as people see them: messages and attachments, answers with links, search reports, file changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx

ATTACHED = "\n\nAttached file "
TITLE = 120
HIT_FLOOR = 200
BATCH_RANGE = 1024


def message_head(message: Column) -> Column:
    """What the user typed, without the notes on attached files."""
    return F.get(F.split(F.coalesce(message, F.lit("")), ATTACHED), F.lit(0))


def attachments(message: Column) -> Column:
    """(name, note) of the files attached to a message."""
    notes = F.slice(F.split(F.coalesce(message, F.lit("")), ATTACHED), 2, 1_000_000)
    first = lambda n: F.regexp_replace(F.get(F.split(F.concat(F.lit("Attached file "), n), "\r\n|\n|\r"), F.lit(0)), " Full text:$", "")
    return F.transform(notes, lambda n: F.struct(F.regexp_replace(F.substring_index(n, " ", 1), ":+$", "").alias("name"), first(n).alias("note")))


def session_list(sessions: DataFrame) -> DataFrame:
    """(id, title, status, started, updated, tokens)."""
    return sessions.select(
        "id", F.left(message_head(F.col("task")), F.lit(TITLE)).alias("title"), "status", F.col("started_at").alias("started"), F.coalesce("finished_at", "started_at").alias("updated"),
        F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
    )


def with_links(answer: Column) -> Column:
    """An answer with [[links]] as Markdown links; their targets are percent-encoded."""
    target, label = r"([^\]|\n]+?)", r"(?:\|([^\]\n]+?))?"
    pieces = F.regexp_extract_all(answer, F.lit(rf"\[\[{target}{label}\]\]"), F.lit(0))
    inner = lambda p: F.substr(p, F.lit(3), F.length(p) - 4)
    shown = lambda p: F.regexp_replace(F.trim(F.substring_index(inner(p), "|", -1)), r"([\[\]])", r"\\$1")
    code = lambda p: F.replace(F.url_encode(F.trim(F.substring_index(inner(p), "|", 1))), F.lit("+"), F.lit("%20"))
    links = F.transform(pieces, lambda p: F.concat(F.lit("["), shown(p), F.lit("](wikilink:"), code(p), F.lit(")")))
    rest = F.split(answer, rf"\[\[{target}{label}\]\]", -1)
    return F.array_join(F.transform(F.arrays_zip(rest.alias("text"), links.alias("link")), lambda x: F.concat(x["text"], F.coalesce(x["link"], F.lit("")))), "")


def with_citations(answer: Column) -> Column:
    """An answer with ``(path.md > Heading; other.md)`` as links; brackets with anything else stay."""
    group = r"\(([^()\n]*?\.(?:md|txt)\b[^()\n]*)\)"
    one = r"^\s*([^;>\[\]]+?\.(?:md|txt))\s*(?:>\s*(.+?))?\s*$"

    def link(part: Column) -> Column:
        path = F.trim(F.regexp_extract(part, one, 1))
        name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(md|txt)$", "")
        where = F.trim(F.substring_index(F.regexp_extract(part, one, 2), ">", -1))
        label = F.when((where != "") & (where != name), F.concat(name, F.lit(" › "), where)).otherwise(name)
        code = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
        return F.concat(F.lit("["), F.regexp_replace(label, r"([\[\]])", r"\\$1"), F.lit("](note:"), code, F.lit(")"))

    def rewritten(found: Column) -> Column:
        parts = F.split(F.substr(found, F.lit(2), F.length(found) - 2), ";")
        return F.when(F.forall(parts, lambda p: p.rlike(one)), F.array_join(F.transform(parts, link), " ")).otherwise(found)

    new = F.transform(F.regexp_extract_all(answer, F.lit(group), F.lit(0)), rewritten)
    rest = F.split(answer, group, -1)
    return F.array_join(F.transform(F.arrays_zip(rest.alias("text"), new.alias("new")), lambda x: F.concat(x["text"], F.coalesce(x["new"], F.lit("")))), "")


def open_note(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(rid, path) that each request (rid, name, here) means: by path ending or stem, in its folder first."""
    names = requests.withColumn("_stem", tx.stem(F.col("name")))
    known = files.select("path", tx.stem(F.col("path")).alias("_stem"))
    bare = F.regexp_replace(F.lower("path"), r"\.(md|txt)$", "")
    fits = ~F.col("name").contains("/") | bare.endswith(F.lower(F.regexp_replace("name", r"\.(md|txt)$", "")))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    order = F.struct((folder != F.coalesce("here", F.lit(""))).cast("int"), F.col("path"))
    return names.join(known, "_stem").where(fits).groupBy("rid").agg(F.min_by("path", order).alias("path"))


def visible(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """A graph view without some kinds of nodes or edges; ``radius`` grows with the root of the degree."""
    shown = nodes.where(~F.col("kind").isin(hidden)).withColumn("radius", F.round(F.sqrt(F.col("degree").cast("double")), 6))
    ids = shown.select("id")
    kept = edges.where(~F.col("kind").isin(hidden))
    kept = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, kept


def search_report(hits: DataFrame, relations: DataFrame, room: int) -> DataFrame:
    """(qid, report) of ``hits`` (qid, place, label, text) and ``relations`` (qid, rank, source, relation, target, where).

    The first line names all sources; texts share the room that is left, with a floor for each.
    """
    order = lambda c, *fields: F.array_sort(F.collect_list(F.struct(c, *fields)))
    found = hits.groupBy("qid").agg(order("place", "label", "text").alias("hits"))
    facts = relations.groupBy("qid").agg(order("rank", "source", "relation", "target", "where").alias("facts"))
    rows = found.join(facts, "qid", "full_outer")
    number = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    head = F.concat(F.lit("found: "), F.array_join(F.transform(F.coalesce("hits", F.array()), lambda h, i: F.concat(number(i), h["label"])), ", "))
    lines = F.transform("facts", lambda f: F.concat(F.lit("- "), f["source"], F.lit(" --"), f["relation"], F.lit("--> "), f["target"], F.lit("  ("), f["where"], F.lit(")")))
    graph = F.coalesce(F.concat(F.lit("\n\nFacts from the notes:\n"), F.array_join(lines, "\n")), F.lit(""))
    rows = rows.withColumn("_head", head).withColumn("_graph", graph)
    per = F.greatest(F.lit(HIT_FLOOR), ((F.lit(room) - F.length("_head") - F.length("_graph")) / F.greatest(F.size("hits"), F.lit(1))).cast("int") - 40)
    body = F.array_join(F.transform(F.coalesce("hits", F.array()), lambda h, i: F.concat(number(i), h["label"], F.lit("\n"), F.left(h["text"], F.col("_per")))), "\n\n")
    return rows.withColumn("_per", per).select("qid", F.concat("_head", F.lit("\n\n"), body, "_graph").alias("report"))


def token_statistics(passages: DataFrame) -> DataFrame:
    """One row: distinct words, and words per passage."""
    words = passages.select(tx.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    per = words.agg(F.round(F.avg(F.size("words")), 6).alias("tokens_per_passage"))
    return words.select(F.explode("words").alias("w")).agg(F.count_distinct("w").alias("distinct_tokens")).crossJoin(per)


def registry_audit(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(tool, arg, problem): where a registry (tool, arg, required) and signatures (tool, arg, has_default) differ."""
    both = declared.withColumn("_d", F.lit(True)).join(actual.withColumn("_a", F.lit(True)), ["tool", "arg"], "full_outer")
    problem = F.when(F.col("_a").isNull(), "declared, not in the signature").when(F.col("_d").isNull(), "in the signature, not declared").when(F.col("required") == F.col("has_default"), "required and default disagree")
    return both.select("tool", "arg", problem.alias("problem")).where("problem is not null")


def _without(options: Column, upper: Column) -> Column:
    return F.map_filter(options, lambda k, _: ~F.map_contains_key(upper, k))


def resolve_models(roles: DataFrame, models: DataFrame, vendors: DataFrame) -> DataFrame:
    """(role, model, vendor, options): options of the vendor, overruled by the model's, then the role's."""
    rows = roles.select("role", "model", F.col("options").alias("_r")).join(models.select("model", "vendor", F.col("options").alias("_m")), "model").join(vendors.select("vendor", F.col("options").alias("_v")), "vendor")
    empty = F.create_map().cast("map<string,string>")
    options = empty
    for layer in ("_v", "_m", "_r"):
        upper = F.coalesce(layer, empty)
        options = F.map_concat(_without(options, upper), upper)
    return rows.select("role", "model", "vendor", options.alias("options"))


def provider_error(status: Column, body: Column) -> Column:
    """Why a provider refused, in plain words, or null: too large a request, or a spent daily budget."""
    sizes = r"Limit (\d+), (?:Used \d+, )?Requested (\d+)"
    limit, asked = (F.format_number(F.regexp_extract(body, sizes, i).try_cast("long"), 0) for i in (1, 2))
    detail = F.coalesce(F.concat(F.lit(" ("), asked, F.lit(" tokens, at most "), limit, F.lit(")")), F.lit(""))
    wait = F.regexp_extract(body, r"try again in ([\dhms.]+)", 1)
    freed = F.when(wait != "", F.concat(F.lit("; try again in "), wait)).otherwise("")
    too_large = F.concat(F.lit("the plan does not take a request of this size"), detail, F.lit("; shorten the conversation"))
    spent = F.concat(F.lit("no tokens of this model are left today"), freed)
    return F.when(status == 413, too_large).when((status == 429) & body.contains("per day"), spent)


def retry_after(header: Column, body: Column, attempt: Column, most: float = 60.0) -> Column:
    """Seconds to wait: the longer of the hints and an exponential backoff, at most ``most``."""
    said, unit = F.regexp_extract(body, r"try again in ([\d.]+)(ms|s)", 1).try_cast("double"), F.regexp_extract(body, r"try again in ([\d.]+)(ms|s)", 2)
    hint = F.coalesce(said / F.when(unit == "ms", 1000).otherwise(1), F.lit(0.0))
    return F.least(F.lit(most), F.greatest(F.coalesce(header.try_cast("double"), F.lit(0.0)), hint, F.pow(F.lit(2.0), attempt + 1)))


def redact(text: Column, secrets: list[str]) -> Column:
    """``text`` without the given strings."""
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text
    return text


def event_lines(events: DataFrame) -> DataFrame:
    """(line): one JSON line per row, as a server sends events."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("line"))


def prompts(sections: DataFrame, batch: str, instructions: str) -> DataFrame:
    """(batch, batch_ids, prompt) for extraction: the labelled texts of each batch's sections, in order."""
    text = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text"))
    rows = sections.select(F.col(batch).alias("batch"), F.struct("path", "ord", "key", text.alias("text")).alias("x"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    labelled = F.array_join(F.transform("x", lambda x: F.concat(F.lit("[chunk "), x["key"], F.lit("]\n"), x["text"])), "\n\n")
    return grouped.select("batch", F.transform("x", lambda x: x["key"]).alias("batch_ids"), F.concat(F.lit(instructions), F.lit("\n\n"), labelled).alias("prompt"))


def ask(requests: DataFrame, model, batch_size: int = 16) -> DataFrame:  # noqa: ANN001
    """``requests`` (with a column prompt) and the model's ``reply``; ``model`` takes and gives a list."""

    def run(parts: pd.Series) -> pd.Series:
        texts = parts.tolist()
        return pd.Series([r for i in range(0, len(texts), batch_size) for r in model(texts[i : i + batch_size])])

    return requests.withColumn("reply", F.pandas_udf(run, "string")(F.col("prompt")))  # type: ignore[call-overload]


def budgeted(batches: DataFrame, cost: str, budget: int) -> DataFrame:
    """Batches in order until the cost of those before reaches the budget; the others wait.

    Costs are summed within ranges of BATCH_RANGE batch numbers, and only the ranges' totals in one task.
    """
    ranged = batches.withColumn("_range", F.floor(F.col("batch") / BATCH_RANGE))
    totals = ranged.groupBy("_range").agg(F.sum(cost).alias("_cost"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_cost").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum(cost).over(within), F.lit(0))
    return ranged.join(totals, "_range").withColumn("runs", before < budget).select(*batches.columns, "runs")


def extraction_outcome(outcomes: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(progress, saved) of a run over ``outcomes`` (batch, keys, failed, tokens, triples), one row a batch.

    The run ends before the first batch that finds the budget spent, and after the first with a failure;
    ``keys`` and ``failed`` list a batch's sections. ``progress`` has a row per batch that ran: running
    totals ``done``, ``failed``, ``tokens``, ``triples``, and ``stopped``, why the run ended there or null.
    ``saved`` (key) are the sections to store; all others stay pending.
    """
    sizes = outcomes.select("batch", (F.size("keys") - F.size("failed")).cast("long").alias("done"), F.size("failed").cast("long").alias("failed"), "tokens", "triples")
    sizes = sizes.withColumn("_range", F.floor(F.col("batch") / BATCH_RANGE))
    names = ("done", "failed", "tokens", "triples")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_range").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    bases = sizes.groupBy("_range").agg(*(F.sum(c).alias(c) for c in names))
    bases = bases.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names))
    rolled = sizes.select("_range", "batch", F.col("tokens").alias("own"), F.col("failed").alias("own_failed"), *(F.sum(c).over(within).alias(c) for c in names)).join(bases, "_range")
    rolled = rolled.select("batch", "own", "own_failed", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in names))
    starts = (F.col("failed") == F.col("own_failed")) & (F.lit(True) if budget is None else F.col("tokens") - F.col("own") < budget)
    spent = F.lit(False) if budget is None else F.col("tokens") >= budget
    why = F.when(F.col("own_failed") > 0, "a call failed, other sections wait").when(spent, f"all {budget or 0:,} tokens are spent")
    progress = rolled.where(starts).select("batch", *names, why.alias("stopped"))
    ran = outcomes.join(progress.select("batch"), "batch", "left_semi")
    return progress, ran.select(F.explode(F.array_except("keys", "failed")).alias("key"))
