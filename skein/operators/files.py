"""File tools over a table of files (path, text): find, list, read, change, and decide how to attach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx


def find(files: DataFrame, pattern: str, limit: int | None = 100) -> DataFrame:
    """(path) that match a shell pattern, sorted; ``*`` crosses folders. The limit is the report's length."""
    found = files.where(F.col("path").rlike(tx.glob_regex(pattern))).select("path").orderBy("path")
    return found.limit(limit) if limit else found


def named(files: DataFrame, term: str) -> DataFrame:
    """Files whose name, without its folders, contains ``term`` in any case."""
    return files.where(F.contains(F.lower(F.substring_index("path", "/", -1)), F.lit(term.lower())))


def grep(files: DataFrame, pattern: str, include: str | None = None, limit: int | None = 50) -> DataFrame:
    """(path, line, text) of lines with a match, in order; the limit is the report's length."""
    rows = files if include is None else files.where(F.col("path").rlike(tx.glob_regex(include)) | F.substring_index("path", "/", -1).rlike(tx.glob_regex(include)))
    lines = rows.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "text")).where(F.col("text").rlike(pattern))
    found = lines.select("path", (F.col("line") + 1).alias("line"), F.left(tx.strip(F.col("text")), F.lit(200)).alias("text")).orderBy("path", "line")
    return found.limit(limit) if limit else found


def read(files: DataFrame, path: str, offset: int = 1, limit: int = 200) -> DataFrame:
    """(line, text, remaining): lines from ``offset`` (from 1), and how many follow the last."""
    lines = files.where(F.col("path") == path).select(F.split("text", "\r\n|\n|\r").alias("all"))
    rows = lines.select(F.size("all").alias("n"), F.posexplode("all").alias("line", "text")).where(F.col("line").between(offset - 1, offset + limit - 2))
    return rows.select((F.col("line") + 1).alias("line"), "text", F.greatest(F.col("n") - (offset + limit - 1), F.lit(0)).alias("remaining"))


def tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """(parent, name, kind, items): entries down to ``depth``; a folder at the bottom shows its items.

    Order them by parent, then ``kind`` with folders first, then the name in lower case.
    """
    parts = F.split("path", "/")
    levels = files.select("path", parts.alias("parts"), F.posexplode(parts).alias("level", "name"))
    entry = levels.select(F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("parent"), "name", F.when(F.col("level") == F.size("parts") - 1, "file").otherwise("folder").alias("kind"), "level", F.try_element_at("parts", F.col("level") + 2).alias("child"))
    grouped = entry.groupBy("parent", "name", "kind", "level").agg(F.count_distinct("child").alias("items"))
    return grouped.where(F.col("level") < depth).select("parent", "name", "kind", F.when((F.col("kind") == "folder") & (F.col("level") == depth - 1), F.col("items")).alias("items"))


def nested_tree(listing: DataFrame, most: int | None = None) -> DataFrame:
    """(root, tree): one JSON document a root of files (root, path, size), assembled from the deepest level up.

    A folder has name, path, type and children, folders first, then by name in lower case; a file has its size.
    Each level is one aggregation by (root, parent folder). Hidden files, and those in hidden folders, are
    left out. With ``most``, a folder lists so many children, and ``more`` says how many others it has. A path counts
    once, with its greatest size.
    """
    text = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    parts = F.split("path", "/")
    files = listing.where(~F.col("path").rlike(r"(^|/)\.")).groupBy("root", "path").agg(F.max("size").alias("size"))
    files = files.select("root", "path", F.size(parts).alias("level"), F.element_at(parts, -1).alias("name"), F.coalesce(F.col("size").cast("string"), F.lit("null")).alias("size"))
    head = lambda kind: F.concat(F.lit('{"name":'), text(F.col("name")), F.lit(',"path":'), text(F.col("path")), F.lit(f',"type":"{kind}"'))
    leaves = files.select("root", "path", "name", "level", F.lit(1).alias("kind"), F.concat(head("file"), F.lit(',"size":'), "size", F.lit("}")).alias("json"))
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    above = None
    for level in range(deepest, 0, -1):
        here = leaves.where(F.col("level") == level).drop("level")
        here = here if above is None else here.unionByName(above)
        parent = F.array_join(F.slice(F.split("path", "/"), 1, level - 1), "/")
        rows = here.select("root", parent.alias("parent"), F.struct("kind", F.lower("name").alias("low"), "name", "json").alias("x"))
        grouped = rows.groupBy("root", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list("x")).alias("all"))
        shown = F.col("all") if most is None else F.slice("all", 1, most)
        more = F.lit("") if most is None else F.when(F.size("all") > most, F.concat(F.lit(',"more":'), (F.size("all") - most).cast("string"))).otherwise("")
        children = F.concat(F.lit(',"children":['), F.array_join(F.transform(shown, lambda x: x["json"]), ","), F.lit("]"), more, F.lit("}"))
        grouped = grouped.withColumn("name", F.when(F.col("path") == "", F.col("root").cast("string")).otherwise(F.substring_index("path", "/", -1)))
        above = grouped.select("root", "path", "name", F.lit(0).alias("kind"), F.concat(head("folder"), children).alias("json"))
    empty = listing.select("root", F.lit("").alias("tree")).where("false")
    return empty if above is None else above.select("root", F.col("json").alias("tree"))


def replace_text(text: Column, old: str, new: str, every: bool = False) -> Column:
    """(text, error): the edit, or why it cannot be made."""
    count = ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")
    at = F.instr(text, old)
    once = F.concat(F.left(text, at - 1), F.lit(new), F.substr(text, at + len(old)))
    error = F.when(count == 0, "the text was not found").when((count > 1) & F.lit(not every), "the text occurs more than once")
    return F.struct(F.when(error.isNull(), F.replace(text, F.lit(old), F.lit(new)) if every else once).alias("text"), error.alias("error"))


def append(text: Column, more: Column) -> Column:
    """``more`` after ``text``, on a line of its own."""
    return F.when((text == "") | text.endswith("\n"), F.concat(text, more)).otherwise(F.concat(text, F.lit("\n"), more))


def attach_policy(pages: DataFrame, full_text_tokens: int) -> DataFrame:
    """(file, tokens, route): small files go in whole, others into the index with an outline."""
    sized = pages.groupBy("file").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    tokens = (F.col("chars") / 4).cast("long")
    return sized.select("file", tokens.alias("tokens"), F.when(tokens <= full_text_tokens, "full text").otherwise("index").alias("route"))


def unread_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("method").startswith("native, "))


def outline(headings: DataFrame, entries: int = 15) -> DataFrame:
    """Of each file's headings (file, place, text) every n-th, so that about ``entries`` remain."""
    order = Window.partitionBy("file").orderBy("place")
    rows = headings.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("file")))
    step = F.ceil(F.col("_all") / entries)
    rows = rows.where((F.col("_n") - 1) % step == 0).where((F.col("_n") - 1) / step < entries)
    return rows.drop("_n", "_all")


def headings(spans: DataFrame) -> DataFrame:
    """(file, page, text) of headings from text lines (file, page, line, text, size, bold).

    Lines set larger than the body, or bold ones where those are few; without running heads and
    contents entries. A heading that goes on in the next line is joined to it.
    """
    rows = spans.withColumn("text", tx.collapse(F.col("text"))).where("text != ''")
    body = rows.groupBy("file", F.round("size").alias("body")).agg(F.sum(F.length("text")).alias("chars")).groupBy("file").agg(F.max_by("body", F.struct("chars", -F.col("body"))).alias("body"))
    rows = rows.join(body, "file").withColumn("_seen", F.count("*").over(Window.partitionBy("file", "text")))
    n = F.size(F.split("text", " "))
    fine = n.between(2, 14) & (F.col("_seen") <= 2) & ~F.col("text").rlike(r"\.{4,}") & F.col("text").rlike(r"\p{L}")
    rows = rows.where(fine).withColumn("_large", F.col("size") >= 1.15 * F.col("body")).withColumn("_strong", F.col("bold") & (F.col("size") >= F.col("body")))
    rows = rows.withColumn("_few", F.count_if(F.col("_large")).over(Window.partitionBy("file")) < 6)
    rows = rows.where(F.col("_large") | (F.col("_few") & F.col("_strong"))).withColumn("_rank", F.when(F.col("_large"), 0).otherwise(1))
    order = Window.partitionBy("file").orderBy("_rank", "page", "line")
    before, same = F.lag("text").over(order), (F.lag("page").over(order) == F.col("page")) & (F.lag("size").over(order) == F.col("size"))
    open_end = before.rlike(r"[-,]$|(?:^| )(?:and|of|the|to|for|in|a|not|with)$") | F.col("text").rlike(r"^\p{Ll}")
    joins = F.coalesce(same & open_end & (F.size(F.split(F.concat_ws(" ", before, "text"), " ")) <= 18), F.lit(False))
    rows = rows.withColumn("_new", (~joins).cast("int")).withColumn("_group", F.sum("_new").over(order))
    grouped = rows.groupBy("file", "_group").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("_rank", "page", "line", "text"))).alias("x"))
    joined = F.regexp_replace(F.array_join(F.transform("x", lambda x: x["text"]), "\u0001"), "-\u0001", "")
    return grouped.select("file", "page", F.replace(joined, F.lit("\u0001"), F.lit(" ")).alias("text"))


def snapshot(entries: DataFrame, budget: int, by: str = "workspace") -> DataFrame:
    """``entries`` (workspace, path, text) with ``whole``: in order of path, until their total passes the budget."""
    total = F.sum(F.length("text")).over(Window.partitionBy(by).orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("whole", total <= budget)


def without_secrets(environment: Column) -> Column:
    """A map without the entries whose names look like secrets."""
    words = ("KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL")
    return F.map_filter(environment, lambda k, _: ~F.upper(k).rlike("|".join(words)))
