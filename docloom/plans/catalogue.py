"""The registered queries of the library's own operators, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from docloom.plans import answers, chains, compiled, conversations, documents, evaluation, extra, legal, more, records, rest, retrieval, sparse, stores, vectors  # noqa: E402, F401  (they register)
