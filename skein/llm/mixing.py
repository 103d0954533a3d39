"""Mixing sources to target weights: budgets flow down a domain-language-source tree.

The token budget is divided at each node among its children by weight. A child cannot take more than
``max_epochs`` times the tokens below it; what it leaves goes to its siblings by weight, and only
what all of them together cannot take is left to the siblings of an ancestor, because each node's
capacity is the sum of its leaves'. A leaf repeats its documents for as many whole epochs as its
budget covers, and takes a prefix of one more epoch, whose order is a seeded hash of the document.
Only built-in functions run; budgets are exact integers.

Plan: a slim table (no text) is written to the checkpoint folder once and read from there. The tree
holds one row per leaf. The prefix of a leaf, which may have a third of all rows, is found without
gathering it (its budget is sent to its documents if the leaves, once counted, are few): its order is dealt into 4,096 ranges by hash, ranges are summed, the sums are
accumulated, and rows are only ordered within their range.

Defined results: documents without a word are never drawn; null languages, sources and texts count
as empty ones. Repeated rows, alike in id, text and leaf, are one document, and ``mix`` repeats each
of them alike. Other columns are carried through by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, cut, pack, unpack

DOMAINS = ("web", "reference", "forum", "code")
WEIGHTS = {
    "domain": {"web": 40, "reference": 30, "forum": 20, "code": 10},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {},
}
LEVELS = ("domain", "lang", "source")
BUDGET_PERCENT = 80
MAX_EPOCHS = 3
SEED = "skein-mix-1"
#: Leaves up to which their budgets are sent to the documents; beyond it both sides are shuffled.
BROADCAST_LEAVES = 200_000


def domain_of(source: Column) -> Column:
    """The domain of a source by the number that ends its name; without one, the first domain."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.get(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The weight of a child; names that are not given weigh 1."""
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def _wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _divide(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide ``_mbudget`` of each parent among its children by ``_mw`` up to ``_mcap``."""
    family = Window.partitionBy(*parents)
    ordered = family.orderBy((F.col("_mcap") / F.col("_mw")).cast("double"), name)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    df = nodes.withColumn("_mleft", F.col("_mbudget") - F.coalesce(F.sum("_mcap").over(before), F.lit(0))).withColumn("_mrest", F.sum("_mw").over(after))
    df = df.withColumn("_mfull", _wide("_mcap") * _wide("_mrest") <= _wide("_mleft") * _wide("_mw"))
    df = df.withColumn("_mtaken", F.coalesce(F.sum(F.when(F.col("_mfull"), F.col("_mcap"))).over(family), F.lit(0)))
    df = df.withColumn("_mweights", F.sum(F.when(~F.col("_mfull"), F.col("_mw"))).over(family))
    share = F.expr("(cast(_mbudget - _mtaken as decimal(20,0)) * cast(_mw as decimal(18,0))) div _mweights")
    return df.withColumn("_mbudget", F.when(F.col("_mfull"), F.col("_mcap")).otherwise(share)).drop("_mleft", "_mrest", "_mfull", "_mtaken", "_mweights", "_mw", "_mcap")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, n_available, n_budget) from (domain, lang, source, n_available)."""
    capped = leaves.withColumn("_mcap", F.col("n_available") * max_epochs)
    root = leaves.agg(F.least(F.expr(f"cast(sum(n_available) as decimal(20,0)) * {budget_percent} div 100"), F.sum("n_available") * max_epochs).alias("_mbudget"))
    budgets: DataFrame = root.withColumn("_mroot", F.lit(0))
    parents: list[str] = ["_mroot"]
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = capped.groupBy(*path).agg(F.sum("_mcap").alias("_mcap")).withColumn("_mw", _weight(level, weights))
        nodes = nodes if depth else nodes.withColumn("_mroot", F.lit(0))
        budgets = _divide(nodes.join(budgets, parents), parents, level).select(*path, "_mbudget")
        parents = path
    return budgets.withColumnRenamed("_mbudget", "n_budget").join(leaves, list(LEVELS))


def _order(epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_mtext")))


def select(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per drawn document: doc_id, its leaf, n_tokens and n_copies (epochs that it is in)."""
    body = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        domain_of(F.coalesce("source", F.lit(""))).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.md5(body).alias("_mtext"),
    )
    slim = cut(slim.where("n_tokens > 0").dropDuplicates(["doc_id", "_mtext", "lang", "source"]))
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_available"))
    plan = leaf_budgets(leaves, weights, budget_percent, max_epochs)
    plan = cut(plan.select(*LEVELS, F.expr("n_budget div n_available").alias("_mepochs"), (F.col("n_budget") % F.col("n_available")).alias("_mprefix")))
    few = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    rows = slim.join(F.broadcast(plan) if few else plan, list(LEVELS)).withColumn("_morder", _order(F.col("_mepochs")))
    rows = rows.withColumn("_mrange", F.substring("_morder", 1, 3))
    ranges = rows.groupBy(*LEVELS, "_mrange").agg(F.sum("n_tokens").alias("_msum"))
    running = Window.partitionBy(*LEVELS).orderBy("_mrange").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*LEVELS, "_mrange", F.coalesce(F.sum("_msum").over(running), F.lit(0)).alias("_mstart"))
    within = Window.partitionBy(*LEVELS, "_mrange").orderBy("_morder", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(ranges, [*LEVELS, "_mrange"]).withColumn("_mend", F.col("_mstart") + F.sum("n_tokens").over(within))
    copies = F.col("_mepochs") + F.when(F.col("_mend") <= F.col("_mprefix"), 1).otherwise(0)
    return placed.withColumn("n_copies", copies.cast("long")).where("n_copies > 0").select("doc_id", *LEVELS, "n_tokens", "n_copies", "_mtext")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The drawn documents with all their columns, each as often as it has epochs."""
    drawn = select(docs, weights, budget_percent, max_epochs).select(
        F.col("doc_id").alias("_mid"), F.col("lang").alias("_mlang"), F.col("source").alias("_msource"), F.col("_mtext").alias("_mhash"), F.col("n_copies").alias("_mcopies")
    )
    packed = pack(docs, _mdoc=F.col("doc_id"), _mtext=F.md5(F.coalesce("text", F.lit(""))), _mdoclang=F.coalesce("lang", F.lit("")), _mdocsource=F.coalesce("source", F.lit("")))
    same = F.col("_mdoc").eqNullSafe(F.col("_mid")) & (F.col("_mtext") == F.col("_mhash"))
    same &= (F.col("_mdoclang") == F.col("_mlang")) & (F.col("_mdocsource") == F.col("_msource"))
    again = packed.join(drawn, same).withColumn("_mcopy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mcopies"))))
    return unpack(again, docs.columns, {})


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"(CASE {level} {cases} ELSE 1 END)" if cases else "1"


def _sql_level(name: str, parent: str, keys: list[str], path: list[str]) -> str:
    """CTEs that divide the budgets of ``parent`` among the children at ``path``."""
    part = f"PARTITION BY {', '.join(keys)}"
    order = f"{part} ORDER BY cap::DOUBLE / w, {path[-1]}"
    cols = ", ".join(path)
    return f"""
{name}_n AS (SELECT {cols}, sum(cap)::HUGEINT AS cap, max({_sql_weight(path[-1])})::HUGEINT AS w, 0 AS root FROM leaf GROUP BY {cols}),
{name}_o AS (SELECT {name}_n.*, budget, budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}_n JOIN {parent} USING ({', '.join(keys)})),
{name}_f AS (SELECT *, cap * ws <= rest * w AS whole FROM {name}_o),
{name} AS (SELECT root, {cols}, CASE WHEN whole THEN cap ELSE
             ((budget - coalesce(sum(CASE WHEN whole THEN cap END) OVER ({part}), 0)) * w) // (sum(CASE WHEN NOT whole THEN w END) OVER ({part})) END AS budget FROM {name}_f),"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS h,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens,
                  [{', '.join(f"'{x}'" for x in DOMAINS)}][1 + coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % {len(DOMAINS)}] AS domain
           FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS avail, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM d WHERE n_tokens > 0 GROUP BY ALL),
top AS (SELECT 0 AS root, least(sum(avail)::HUGEINT * {BUDGET_PERCENT} // 100, sum(cap)::HUGEINT) AS budget FROM leaf),
{_sql_level("dom", "top", ["root"], ["domain"])}
{_sql_level("lng", "dom", ["domain"], ["domain", "lang"])}
{_sql_level("src", "lng", ["domain", "lang"], ["domain", "lang", "source"])}
plan AS (SELECT domain, lang, source, budget // avail AS epochs, budget % avail AS prefix FROM src JOIN leaf USING (domain, lang, source)),
o AS (SELECT d.*, epochs, prefix, md5('{SEED}|' || epochs || '|' || doc_id || '|' || h) AS k FROM d JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= prefix THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM r WHERE epochs + CASE WHEN upto <= prefix THEN 1 ELSE 0 END > 0
"""
