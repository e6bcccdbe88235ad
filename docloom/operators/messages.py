"""Conversations as rows (conversation, turn, role, text, ...): filtering, merging, trimming to a budget, transcripts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folds import folded

from docloom.functions.text import approximate_tokens

#: roles by the names that different sources use
ROLES = {"human": "user", "user": "user", "ai": "assistant", "assistant": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "function", "chat": "chat", "remove": "remove"}
PREFIXES = {"user": "Human", "human": "Human", "assistant": "AI", "ai": "AI", "system": "System", "tool": "Tool", "function": "Function"}


def role(c: Column | str) -> Column:
    """A role's common name; an unknown one is an error."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, c), F.raise_error(F.concat(F.lit("unknown role: "), c)))


def keep(df: DataFrame, *, include_roles: list[str] | None = None, exclude_roles: list[str] | None = None, include_names: list[str] | None = None, exclude_names: list[str] | None = None, include_ids: list | None = None, exclude_ids: list | None = None, role: str = "role", name: str = "name", id_: str = "id") -> DataFrame:
    """Messages that no exclude list has and, if there are include lists, that one of them has."""
    lists = ((role, include_roles, exclude_roles), (name, include_names, exclude_names), (id_, include_ids, exclude_ids))
    is_in = lambda c, v: F.coalesce(F.col(c).isin(v), F.lit(False))
    out = [is_in(c, ex) for c, _, ex in lists if ex]
    wanted = [is_in(c, inc) for c, inc, _ in lists if inc]
    condition = F.lit(True) if not wanted else reduce(lambda a, b: a | b, wanted)
    return df.where(reduce(lambda a, b: a & ~b, out, condition))


def merge_runs(df: DataFrame, *, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", separator: str = "\n", apart: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Consecutive messages of one role as one: by, order (of the first), role, text, n. Roles in ``apart`` stay as they are."""
    w = Window.partitionBy(by).orderBy(order)
    new = (F.lag(role).over(w).isNull() | (F.lag(role).over(w) != F.col(role)) | F.col(role).isin(*apart)).cast("int")
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return runs.groupBy(by, "__run").agg(F.min(order).alias(order), F.first(role).alias(role), F.array_join(parts, separator).alias(text), F.count("*").alias("n")).drop("__run")


def last_turns(df: DataFrame, k: int, *, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last 2k messages of each conversation."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 2 * k).drop("__n")


def count_tokens(df: DataFrame, *, by: str = "conv_id", text: str = "text", role: str = "role") -> DataFrame:
    return df.groupBy(by).agg(F.sum(approximate_tokens(text, role)).cast("long").alias("tokens"))


def trim(df: DataFrame, budget: float, tokens: Column, *, strategy: str = "last", keep_system: bool = False, start_on: list[str] | None = None, end_on: list[str] | None = None, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """The longest suffix (or prefix, for "first") of each conversation within a budget of tokens.

    end_on: messages after the last of these roles are dropped first (for "last"; for "first" after trimming). start_on: messages
    before the first of these roles are dropped last. keep_system: a leading system message stays and counts (for "last").
    """
    if strategy not in ("first", "last"):
        raise ValueError(f"unknown strategy {strategy!r}")
    df = df.withColumn("__tokens", tokens)
    w = Window.partitionBy(by)
    up, down = w.orderBy(order), w.orderBy(F.desc(order))
    lead = (F.row_number().over(up) == 1) & (F.col(role) == "system") if keep_system and strategy == "last" else F.lit(False)
    df = df.withColumn("__lead", lead).withColumn("__spare", F.lit(budget) - F.coalesce(F.sum(F.when(F.col("__lead"), F.col("__tokens"))).over(w), F.lit(0)))

    def cut_end(d: DataFrame) -> DataFrame:
        last = F.max(F.when(F.col(role).isin(end_on), F.col(order))).over(w)
        return d.withColumn("__last", last).where(F.col("__lead") | (F.col(order) <= F.col("__last"))).drop("__last")

    if end_on and strategy == "last":
        df = cut_end(df)
    body = F.when(F.col("__lead"), 0).otherwise(F.col("__tokens"))
    df = df.withColumn("__upto", F.sum(body).over(down if strategy == "last" else up)).where(F.col("__lead") | (F.col("__upto") <= F.col("__spare")))
    if end_on and strategy == "first":
        df = cut_end(df)
    if start_on and strategy == "last":
        first = F.min(F.when(F.col(role).isin(start_on) & ~F.col("__lead"), F.col(order))).over(w)
        df = df.withColumn("__first", first).where(F.col("__lead") | (F.col(order) >= F.col("__first"))).drop("__first")
    return df.drop("__tokens", "__lead", "__spare", "__upto")


def transcript(df: DataFrame, *, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", prefixes: dict[str, str] | None = None) -> DataFrame:
    """by and transcript: a line for each message, with its role's prefix."""
    names = F.create_map(*(F.lit(x) for kv in (prefixes or PREFIXES).items() for x in kv))
    line = F.concat(F.coalesce(F.try_element_at(names, F.col(role)), F.col(role)), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    rows = df.select(by, F.struct(F.col(order).alias("o"), line.alias("line")).alias("x"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("transcript"))


def neighbours(df: DataFrame, value: str, *, by: str, order: str) -> DataFrame:
    """df with the previous and next value within each group."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumns({f"previous_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def within_budget(df: DataFrame, length: Column, budget: int, *, by: str, order: str) -> DataFrame:
    """Rows of each group in order while something of the budget is left after each."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("__upto", F.sum(length).over(w)).where(F.col("__upto") < budget).drop("__upto")


def summary_cutoff(df: DataFrame, budget: int, tokens: Column, *, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """by and cutoff: the first message of the earliest suffix within the budget that doesn't begin with a tool message."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    tail = df.withColumn("__upto", F.sum(tokens).over(w)).where(F.col("__upto") <= budget)
    return tail.where(F.col(role) != "tool").groupBy(by).agg(F.min(order).alias("cutoff"))


def clear_old_tool_results(df: DataFrame, keep: int = 3, placeholder: str = "[cleared]", *, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df with all but the last tool results of each conversation replaced by a placeholder."""
    w = Window.partitionBy(by, F.col(role) == "tool").orderBy(F.desc(order))
    old = (F.col(role) == "tool") & (F.row_number().over(w) > keep)
    return df.withColumn("__old", old).withColumn(text, F.when(F.col("__old"), placeholder).otherwise(F.col(text))).drop("__old")


def pair_calls(calls: DataFrame, results: DataFrame, key: str = "call_id") -> DataFrame:
    """Tool calls with their results; calls without one have nulls."""
    return calls.join(results, key, "left")


def call_numbers(df: DataFrame, limit: int, *, by: str, order: str) -> DataFrame:
    """df with each call's number in its thread and whether it is over the limit."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("call_no", F.row_number().over(w)).withColumn("over_limit", F.col("call_no") > limit)


def pack_consecutive(df: DataFrame, length: Column, most: int, *, by: str, order: str) -> DataFrame:
    """df with group_no from 0: consecutive rows share a group while their lengths sum to ``most`` at most; a longer row is an error.

    The fold reads a key's rows in order, one after the other; it gets their places and lengths, not their contents.
    """

    class Groups:
        def __init__(self):
            self.total = self.no = 0

        def step(self, at: object, n: int) -> list[tuple]:
            if n > most:
                raise ValueError("a row is longer than a group may be")
            self.total += n
            if self.total > most:
                self.total, self.no = n, self.no + 1
            return [(at, self.no)]

        def end(self) -> list[tuple]:
            return []

    lengths = df.select(by, order, F.coalesce(length, F.lit(0)).cast("long").alias("__n"))
    placed = folded(lengths, Groups, f"`{order}` {dict(df.dtypes)[order]}, group_no int", by=by, order=[order], values=[order, "__n"])
    return df.join(placed, [by, order])
