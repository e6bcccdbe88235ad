"""Memories beyond a window of messages: combined ones, facts about entities, and what a window drops, kept as vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import stored


def combined(*memories: DataFrame, by: str = "conv_id") -> DataFrame:
    """Several memories' columns side by side; a column that two of them have is an error."""
    names = [c for m in memories for c in m.columns if c != by]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"memories share the names {twice}")
    return reduce(lambda a, b: a.join(b, by, "full"), memories)


def entities(facts: DataFrame, *, entity: str = "entity", fact: str = "fact", order: str = "turn", by: str | None = None, now: Column | None = None, keep: float | None = None, time: str | None = None) -> DataFrame:
    """The latest fact about each entity (of each conversation); with now, keep (seconds) and time, facts that are too old are forgotten."""
    keys = [by, entity] if by else [entity]
    if keep is not None:
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
        facts = facts.where(age <= keep * 1e6)
    return facts.where(F.col(fact).isNotNull()).groupBy(*keys).agg(F.max_by(fact, order).alias(fact), F.max(order).alias(order))


NAMES = 20_000  # names that are broadcast


def mentioned(messages: DataFrame, names: DataFrame, *, text: str = "text", entity: str = "entity", few: int = NAMES) -> DataFrame:
    """messages with an array of the known entities they name, in order of name; a row stays a row. The names are words.

    Few names go with the messages as one map; more are joined by word with messages that a stored id names.
    """
    known = names.where(F.col(entity).isNotNull()).select(F.lower(entity).alias("w"), F.col(entity).alias("e")).distinct()
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\pL\pN]+"))
    if known.count() <= few:
        all_ = known.groupBy("w").agg(F.collect_list("e").alias("e")).agg(F.map_from_entries(F.collect_list(F.struct("w", "e"))).alias("__known"))
        found = F.transform(F.array_intersect(words, F.map_keys("__known")), lambda w: F.element_at(F.col("__known"), w))
        return messages.crossJoin(F.broadcast(all_)).select(*messages.columns, F.array_sort(F.flatten(found)).alias("entities"))
    rows = stored(messages.withColumn("__id", F.monotonically_increasing_id()), "messages")
    each = rows.select("__id", F.explode(words).alias("w")).join(known, "w").groupBy("__id").agg(F.array_sort(F.collect_set("e")).alias("entities"))
    return rows.join(each, "__id", "left").select(*messages.columns, F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def overflow(messages: DataFrame, budget: float, tokens: Column, *, by: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(messages within the budget, from the last back; those before, which a vector table may keep)."""
    upto = F.sum(tokens).over(Window.partitionBy(by).orderBy(F.desc(order)))
    marked = messages.withColumn("__in", upto <= budget)
    return marked.where("__in").drop("__in"), marked.where("NOT __in").drop("__in")
