"""Retrievers: a table of vectors behind one interface, and what is built on it (rewriting, compression, reranking, tools).

A retriever takes many queries at once: a table (query_id, query_embedding, ...) gives hits (query_id, row_id, rank, the
row's columns, and score where the search has one). Steps after it are functions from hits to hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import search

SEARCH_TYPES = ("similarity", "similarity_score_threshold", "mmr")
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Retriever:
    """A search over rows; ``how`` has its numbers: k, score_threshold (0 to 1), fetch_k, weight, where, metric."""

    rows: DataFrame
    search_type: str = "similarity"
    row_id: str = "id"
    vector: str = "embedding"
    how: dict = field(default_factory=dict)
    steps: tuple[Step, ...] = ()

    def __post_init__(self):
        if self.search_type not in SEARCH_TYPES:
            raise ValueError(f"search type {self.search_type!r} isn't one of {SEARCH_TYPES}")
        limit = self.how.get("score_threshold")
        if self.search_type == "similarity_score_threshold" and not (isinstance(limit, float | int) and 0 <= limit <= 1):
            raise ValueError("a search by threshold needs a score_threshold from 0 to 1")

    def __call__(self, queries: DataFrame) -> DataFrame:
        how = {"row_id": self.row_id, "vector": self.vector}
        given = lambda *names: {n: self.how[n] for n in names if n in self.how}
        if self.search_type == "mmr":
            hits = search.mmr_search(self.rows, queries, **how, **given("k", "fetch_k", "weight", "where")).withColumnRenamed("position", "rank")
        elif self.search_type == "similarity":
            hits = search.top_k(self.rows, queries, **how, **given("k", "where", "metric", "offset"))
        else:
            hits = search.top_k(self.rows, queries, **how, threshold=self.how["score_threshold"], **given("k", "where"))
        few = search.few_hits(hits)
        hits = self.rows.drop(self.vector).join(few, self.row_id).select(*few.columns, *(c for c in self.rows.columns if c not in (self.row_id, self.vector)))
        for step in self.steps:
            hits = step(hits)
        return hits

    def then(self, *steps: Step) -> Retriever:
        """The same search with steps after it, such as filters and rerankers: contextual compression."""
        return Retriever(self.rows, self.search_type, self.row_id, self.vector, self.how, (*self.steps, *steps))

    def rephrased(self, queries: DataFrame, rewrite: Callable[[Column], Column], embed: Callable[[Column], Column], question: str = "question") -> DataFrame:
        """Hits of each question after a model has rewritten it. With a model that answers the question, its answer is embedded instead."""
        return self(queries.withColumn("query_embedding", embed(rewrite(F.col(question)))))

    def as_tool(self, queries: DataFrame, *, text: str = "text", separator: str = "\n\n", template: Callable[[str], Column] = F.col) -> DataFrame:
        """What a tool that searches returns: query_id, the hits' texts in order as one string (empty without hits), and their number."""
        part = F.struct(F.col("rank").alias("r"), F.coalesce(template(text), F.lit("")).alias("t"))
        found = self(queries).groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("x"))
        joined = queries.select("query_id").distinct().join(found, "query_id", "left")
        return joined.select("query_id", F.coalesce(F.array_join(F.transform("x", lambda p: p["t"]), separator), F.lit("")).alias("content"), F.coalesce(F.size("x"), F.lit(0)).alias("n"))


def at_least(limit: float, score: str = "score") -> Step:
    """Hits with that score or more."""
    return lambda hits: hits.where(F.col(score) >= limit)


def reranked_by(score: Column, n: int = 3, *, row_id: str = "id") -> Step:
    """The n best hits of each query by another score (a cross-encoder's column, say), with new ranks."""
    return lambda hits: search.ranked(hits.drop("rank", "score").withColumn("score", score), ["query_id"], [F.desc("score"), F.col(row_id)], n)


def listwise(order: Callable[[Column], Column], n: int = 3, *, text: str = "text") -> Step:
    """Hits in the order a model gives for a query's list: it gets the texts by rank and returns their numbers (from 0), best first.

    Numbers out of range and repeated ones are passed over; hits that aren't named are dropped.
    """

    def step(hits: DataFrame) -> DataFrame:
        listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))).alias("x"))
        asked = listed.select("query_id", F.array_distinct(F.filter(order(F.transform("x", lambda p: p["t"])).cast("array<int>"), lambda i: (i >= 0) & (i < F.size("x")))).alias("order"), F.transform("x", lambda p: p["rank"]).alias("ranks"))
        new = asked.select("query_id", F.posexplode(F.transform("order", lambda i: F.get("ranks", i))).alias("__at", "rank"))
        placed = hits.join(new, ["query_id", "rank"]).where(F.col("__at") < n)
        return placed.withColumn("rank", F.col("__at") + 1).drop("__at")

    return step


def with_parents(hits: DataFrame, parents: DataFrame, *, parent: str = "parent_id") -> DataFrame:
    """The parent documents of hits on their parts: query_id, parent, rank (of the first part), and the parent's columns."""
    first = hits.groupBy("query_id", parent).agg(F.min("rank").alias("rank"))
    return first.join(parents, parent)


def children(documents: DataFrame, split: Column, *, key: str = "doc_id", parent: str = "parent_id", text: str = "text") -> DataFrame:
    """The parts of documents, each with its parent's key and a key of its own ("parent:number"); the columns of the document are kept."""
    rest = [c for c in documents.columns if c not in (key, text)]
    rows = documents.select(F.col(key).alias(parent), *rest, F.posexplode(split).alias("part_no", text))
    return rows.withColumn(key, F.concat_ws(":", F.col(parent).cast("string"), F.col("part_no").cast("string")))


def chosen_examples(retriever: Retriever, inputs: DataFrame, fields: list[str], *, name: str = "examples") -> DataFrame:
    """inputs (query_id, query_embedding, ...) with the examples a retriever finds for each, in order, as an array of structs: few-shot selection."""
    hits = retriever(inputs.select("query_id", "query_embedding"))
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias(name))
    return inputs.join(listed, "query_id", "left")


def indexed(documents: DataFrame, split: Column, embed: Callable[[Column], Column], *, key: str = "doc_id", text: str = "text", **how) -> Retriever:
    """A retriever over the parts of documents: split, embedded, and kept with their document's key."""
    parts = children(documents, split, key=key, text=text)
    return Retriever(parts.withColumn("embedding", embed(F.col(text))), row_id=key, how=how)
