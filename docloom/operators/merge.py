"""Merging: usage counts, nested values, metadata of collapsed documents, keyed maps, old and new records, caches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.folds import folded


def usage_totals(df: DataFrame, by: list[str], leaves: list[str]) -> DataFrame:
    """Sums of usage counts (struct paths allowed), null as 0, by group."""
    return df.groupBy(*by).agg(*(F.sum(F.coalesce(F.col(x), F.lit(0))).alias(x.replace(".", "_")) for x in leaves))


def usage_less(left: Column, right: Column) -> Column:
    """left - right, not below 0; null counts 0."""
    return F.greatest(F.coalesce(left, F.lit(0)) - F.coalesce(right, F.lit(0)), F.lit(0))


def deep_merge(left: object, right: object) -> object:
    """Nested values merged: strings join, numbers add, dicts merge by key, lists merge by their items' "index", else join."""
    if left is None or right is None:
        return right if left is None else left
    if isinstance(left, dict) and isinstance(right, dict):
        return {k: deep_merge(left.get(k), right.get(k)) for k in dict.fromkeys([*left, *right])}
    if isinstance(left, list) and isinstance(right, list):
        out = list(left)
        place = {x["index"]: i for i, x in enumerate(out) if isinstance(x, dict) and isinstance(x.get("index"), int)}
        for x in right:
            at = place.get(x.get("index")) if isinstance(x, dict) else None
            if at is None:
                out.append(x)
            else:
                out[at] = {**deep_merge({k: v for k, v in out[at].items() if k != "index"}, {k: v for k, v in x.items() if k != "index"}), "index": x["index"]}
        return out
    if type(left) is not type(right):
        raise TypeError(f"can't merge {type(left).__name__} with {type(right).__name__}")
    if isinstance(left, bool) or not isinstance(left, str | int | float):
        if left == right:
            return left
        raise TypeError(f"can't merge {left!r} with {right!r}")
    return left + right


class _Merged:
    """JSON values merged one after the other."""

    def __init__(self, value: object = None, some: bool = False):
        self.value, self.some = value, some

    def step(self, text: str | None) -> list[tuple]:
        if text is not None:
            self.value, self.some = (deep_merge(self.value, json.loads(text)) if self.some else json.loads(text)), True
        return []

    def end(self) -> list[tuple]:
        return [(json.dumps(self.value) if self.some else None,)]

    def dump(self) -> str:
        return json.dumps([self.value, self.some])

    load = classmethod(lambda cls, text: cls(*json.loads(text)))


def folded_json(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """JSON chunks of each group merged in order: by, value. Of a stream, what is merged after each micro-batch."""
    return folded(df, _Merged, f"{value} string", by=by, order=[order], values=[value])


def collapsed_metadata(df: DataFrame, by: list[str], order: str, metadata: str = "metadata") -> DataFrame:
    """by, key and value: values of a key over a group's documents, in order, joined by ", "."""
    rows = df.select(*by, order, F.explode(metadata).alias("key", "v"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "v"))), lambda x: x["v"].cast("string"))
    return rows.groupBy(*by, "key").agg(F.array_join(parts, ", ").alias("value"))


def keep_fields(metadata: Column | str, fields: list[str]) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(fields))


def right_wins(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed values after an update: new values win, a null new value deletes the key."""
    o, n = old.select(key, F.col(value).alias("__o")), new.select(key, F.col(value).alias("__n"), F.lit(True).alias("__has"))
    return o.join(n, key, "full").where("__has IS NULL OR __n IS NOT NULL").select(key, F.coalesce("__n", "__o").alias(value))


def coalesced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key of either; values of new where they aren't null."""
    names = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in names)).join(new, keys, "full")
    return both.select(*keys, *(F.coalesce(c, f"__{c}").alias(c) for c in names))


def best_answer(df: DataFrame, by: list[str], answer: str, score: str, order: str) -> DataFrame:
    """The answer of the highest score in each group; the first in order wins ties."""
    return df.groupBy(*by).agg(F.max_by(answer, F.struct(F.col(score), -F.col(order))).alias(answer), F.max(score).alias(score))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], value: str, compute) -> tuple[DataFrame, DataFrame]:
    """(requests with values, cache with new rows): known keys are looked up, each distinct missing key is computed once.

    compute: DataFrame of missing keys -> the same with the value column.
    """
    missing = requests.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
    full = cache.select(*keys, value).unionByName(compute(missing).select(*keys, value))
    return requests.join(full, keys, "left"), full


def newest(df: DataFrame, most: int, order: str) -> DataFrame:
    """The last rows in order; what a cache of that size keeps."""
    return df.orderBy(F.desc(order)).limit(most)


class Bucket:
    """A token bucket: one request takes a token; tokens come in at a rate up to a size."""

    def __init__(self, per_second: float, size: float):
        self.per_second, self.size, self.left, self.last = per_second, float(size), float(size), None

    def take(self, time: float) -> bool:
        """Whether a request at a time (in seconds) goes through. The clock doesn't go back: an earlier time counts as the last."""
        if self.last is not None:
            time = max(time, self.last)
            self.left = min(self.size, self.left + (time - self.last) * self.per_second)
        self.last = time
        allowed = self.left >= 1
        self.left -= allowed
        return allowed


def rate_limited(df: DataFrame, per_second: float, bucket: float, *, by: str, time: str, order: str | None = None) -> DataFrame:
    """df with allowed: a token bucket of a size, filled at a rate, for each key; requests in order of time (in seconds), then of ``order``.

    A key's requests pass through a task one after the other, and what is kept of a key is two numbers. Also of a stream:
    requests of a micro-batch are taken in that order, and those that come in a later one after them.
    """
    names = df.columns
    at = names.index(time)
    row = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != by)

    class Limited(Bucket):
        def __init__(self):
            super().__init__(per_second, bucket)

        def step(self, *value) -> list[tuple]:
            when = value[at]
            when = when.timestamp() if hasattr(when, "timestamp") else float(when)
            return [(*(v for n, v in zip(names, value, strict=True) if n != by), bool(self.take(when)))]

        def end(self) -> list[tuple]:
            return []

        def dump(self) -> str:
            return json.dumps([self.left, self.last])

        @classmethod
        def load(cls, text: str):
            new = cls()
            new.left, new.last = json.loads(text)
            return new

    got = folded(df, Limited, f"{row}, allowed boolean", by=by, order=[time, *([order] if order else [])], values=names)
    return got.select(*names, "allowed")
