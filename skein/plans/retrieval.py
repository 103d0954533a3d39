"""Retrieval types: how lists of dense and BM25 hits become an answer, for many queries at once.

``queries`` is (qid, text), ``passages`` (id, text, vec) and ``encode`` adds ``vec`` to (qid, text).
Thresholds branch inside the plan, by query. Lists that several branches read (a few rows a query) are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import bm25, dense, entity_graph, fusion
from skein.plans.lineage import cut

CANDIDATES = 25
GRAPH_SEEDS = 8
RETRY_BELOW, CORRECT_FROM = 0.72, 0.75
LONG_QUERY = 5
WIDER = " evidence source"
TYPES = ("dense", "bm25", "hybrid", "graph", "agentic", "corrective", "multimodal", "agentic-llm", "corrective-llm")
Encoder = Callable[[DataFrame], DataFrame]
#: Asks a model: (qid, prompt) to (qid, reply).
Model = Callable[[DataFrame], DataFrame]

PLAN_PROMPT = "Rewrite the question as a short search query. Reply with JSON only: {\"query\": \"...\", \"keywords\": true or false}\nQuestion: "
GRADE_PROMPT = "Which numbered passages help to answer the question? Reply with JSON only: {\"relevant\": [numbers]}\nQuestion: "


class Searcher:
    """Searches one corpus; plans are lazy and share nothing but their inputs."""

    def __init__(self, passages: DataFrame, encode: Encoder, graph: DataFrame | None = None, images: DataFrame | None = None, encode_image_query: Encoder | None = None, model: Model | None = None) -> None:
        """``images`` is (file, page, vec) for pages of passages that have ``file`` and ``page``."""
        self.passages, self.encode = passages, encode
        self.graph, self.images, self.encode_image_query, self.model = graph, images, encode_image_query, model

    def search(self, queries: DataFrame, kind: str = "hybrid", k: int = 5) -> DataFrame:
        """(qid, rank, id, score) of the k best passages."""
        if kind not in TYPES:
            raise ValueError(f"unknown retrieval type '{kind}' (have: {', '.join(TYPES)})")
        if kind.endswith("-llm") and self.model is None:
            raise ValueError(f"'{kind}' needs a model")
        if kind == "multimodal" and self.images is None:
            raise ValueError("multimodal needs page images")
        return getattr(self, "_" + kind.replace("-", "_"))(queries, k)

    def _list_dense(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        return dense.search(self.encode(queries).select("qid", "vec"), self.passages.select("id", "vec"), k)

    def _list_bm25(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        return bm25.search(queries, self.passages.select("id", "text"), k)

    def _dense(self, queries: DataFrame, k: int) -> DataFrame:
        return self._list_dense(queries, k)

    def _bm25(self, queries: DataFrame, k: int) -> DataFrame:
        return self._list_bm25(queries, k)

    def _hybrid(self, queries: DataFrame, k: int) -> DataFrame:
        return fusion.fuse([self._list_dense(queries), self._list_bm25(queries)], k)

    def _graph(self, queries: DataFrame, k: int) -> DataFrame:
        """Dense seeds and their neighbours in the entity graph, ordered by dense score."""
        graph = self.graph if self.graph is not None else entity_graph.edges(self.passages.select("id", "text"))
        seeds = self._list_dense(queries, max(k, GRAPH_SEEDS))
        scored = dense.score_pairs(entity_graph.expand(seeds, graph), self.encode(queries).select("qid", "vec"), self.passages.select("id", "vec"))
        return bm25.ranked(scored, k).select("qid", "rank", "id", "score")

    def _agentic(self, queries: DataFrame, k: int) -> DataFrame:
        """Long queries take BM25 along; where the best dense score is low, a wider query joins in."""
        found = cut(self._list_dense(queries))
        long = queries.where(F.size(tx.tokens(F.col("text"))) > LONG_QUERY)
        first = cut(fusion.fuse([found, self._list_bm25(long)], k))
        strong = found.where((F.col("rank") == 1) & (F.col("score") >= RETRY_BELOW)).select("qid")
        weak = queries.join(strong, "qid", "left_anti").withColumn("text", F.concat("text", F.lit(WIDER)))
        again = fusion.fuse([first.join(strong, "qid", "left_anti"), self._list_dense(weak)], k)
        return first.join(strong, "qid", "left_semi").unionByName(again)

    def _corrective(self, queries: DataFrame, k: int) -> DataFrame:
        """Dense hits where the best is good enough, and fusion with BM25 elsewhere."""
        found = cut(self._list_dense(queries))
        good = found.where((F.col("rank") == 1) & (F.col("score") >= CORRECT_FROM)).select("qid")
        poor = queries.join(good, "qid", "left_anti")
        fused = fusion.fuse([found.join(good, "qid", "left_anti"), self._list_bm25(poor)], k)
        return found.join(good, "qid", "left_semi").where(F.col("rank") <= k).unionByName(fused)

    def _multimodal(self, queries: DataFrame, k: int) -> DataFrame:
        """Dense hits fused with page images; an image stands for the first passage of its page."""
        assert self.images is not None and self.encode_image_query is not None
        first = self.passages.groupBy("file", "page").agg(F.min("id").alias("id"))
        numbered = self.images.join(first, ["file", "page"]).select("id", "vec")
        seen = dense.search(self.encode_image_query(queries).select("qid", "vec"), numbered, CANDIDATES)
        return fusion.fuse([self._list_dense(queries), seen], k)

    def _ask(self, queries: DataFrame, prompt: str, schema: str, body: str = "text") -> DataFrame:
        """(qid, answer): the model's JSON object, null if it cannot be read."""
        assert self.model is not None
        replies = self.model(queries.select("qid", F.concat(F.lit(prompt), F.col(body)).alias("prompt")))
        return replies.select("qid", F.from_json(tx.json_object(F.col("reply")), schema).alias("answer"))

    def _planned(self, queries: DataFrame) -> DataFrame:
        """(qid, text, query, keywords): with the model's rewriting, or the text itself."""
        plan = self._ask(queries, PLAN_PROMPT, "query string, keywords boolean")
        query = F.when(F.coalesce("answer.query", F.lit("")) != "", F.col("answer.query")).otherwise(F.col("text"))
        return queries.join(plan, "qid", "left").select("qid", "text", query.alias("query"), F.coalesce("answer.keywords", F.lit(True)).alias("keywords"))

    def _agentic_llm(self, queries: DataFrame, k: int) -> DataFrame:
        plan = self._planned(queries)
        both = plan.where("keywords").select("qid", F.concat_ws(" ", "text", "query").alias("text"))
        return fusion.fuse([self._list_dense(plan.select("qid", F.col("query").alias("text"))), self._list_bm25(both)], k)

    def _graded(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """Those of ``hits`` (qid, rank, id) that the model calls relevant."""
        shown = hits.join(self.passages.select("id", F.left("text", F.lit(700)).alias("body")), "id")
        lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["body"]))
        listed = shown.groupBy("qid").agg(F.array_join(lines, "\n\n").alias("passages")).join(queries, "qid")
        asked = listed.select("qid", F.concat_ws("\n\n", "text", "passages").alias("text"))
        keep = self._ask(asked, GRADE_PROMPT, "relevant array<int>").select("qid", F.explode("answer.relevant").alias("rank")).distinct()
        return hits.join(keep, ["qid", "rank"], "left_semi")

    def _corrective_llm(self, queries: DataFrame, k: int) -> DataFrame:
        """Relevant hits first; with too few of them, hits of a rewritten query are graded as well."""
        found = self._list_dense(queries)
        relevant = self._graded(queries, found.where(F.col("rank") <= k))
        enough = relevant.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= min(2, k)).select("qid")
        plan = self._planned(queries.join(enough, "qid", "left_anti"))
        lists = [self._list_dense(plan.select("qid", F.col("query").alias("text"))), self._list_bm25(plan.select("qid", F.concat_ws(" ", "text", "query").alias("text")))]
        fused = fusion.fuse(lists, CANDIDATES)
        fresh = fused.join(relevant.select("qid", "id"), ["qid", "id"], "left_anti")
        fresh = bm25.ranked(fresh.drop("rank"), k)
        second = self._graded(plan.select("qid", "text"), fresh.select("qid", "rank", "id", "score"))
        rest = found.join(enough, "qid", "left_semi").unionByName(fused)
        tiers = [(0, relevant), (1, second), (2, rest)]
        rows = None
        for tier, part in tiers:
            part = part.select("qid", "id", "score", F.struct(F.lit(tier).alias("tier"), F.col("rank").alias("rank")).alias("place"))
            rows = part if rows is None else rows.unionByName(part)
        best = rows.groupBy("qid", "id").agg(F.min("place").alias("place"), F.min_by("score", "place").alias("score"))
        order = F.row_number().over(bm25.Window.partitionBy("qid").orderBy("place", "id"))
        return best.withColumn("rank", order).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def search_notes(queries: DataFrame, sections: DataFrame, encode: Encoder, kind: str = "hybrid", k: int = 5, folder: str = "") -> DataFrame:
    """(qid, rank, id, score) of sections under ``folder``; BM25 counts words over all notes.

    ``sections`` has id (a string), path, heading, text and vec.
    """
    if kind not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown search type '{kind}' (dense, bm25 or hybrid)")
    keys = sections.select("id", F.xxhash64("id").alias("number"))
    within = sections.where(tx.in_folder(F.col("path"), folder)).join(keys, "id")
    body = F.concat_ws(" ", F.replace("path", F.lit("/"), F.lit(" ")), "heading", "text")

    def by_number(hits: DataFrame) -> DataFrame:
        return hits.withColumnRenamed("id", "number").join(keys, "number").select("qid", "rank", "id", "score")

    def by_words(most: int) -> DataFrame:
        passages = sections.select("id", body.alias("text"))
        scored = bm25.scored(queries, passages, bm25.FULL_TEXT).join(within.select("id"), "id", "left_semi")
        return bm25.ranked(scored, most).select("qid", "rank", "id", "score")

    def by_vector(most: int) -> DataFrame:
        return by_number(dense.search(encode(queries).select("qid", "vec"), within.select(F.col("number").alias("id"), "vec").where("vec is not null"), most))

    if kind == "dense":
        return by_vector(k)
    if kind == "bm25":
        return by_words(k)
    return fusion.fuse([by_vector(CANDIDATES), by_words(CANDIDATES)], k)
