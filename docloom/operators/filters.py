"""A filter language compiled to Column predicates, dictionary filters, and a small query language for frames.

Expressions are calls: ``and(gt("price", 10), not(in("brand", ["a", "b"])))``. Values are numbers, strings in single or double
quotes, true and false, dates (2024-01-31), date-times (2024-01-31T10:00:00Z) and lists. Comparisons with null follow SQL.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.numbering import numbered

COMPARATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contain", "like", "in", "nin")
OPERATORS = ("and", "or", "not")


@dataclass(frozen=True)
class Comparison:
    comparator: str
    attribute: str
    value: object


@dataclass(frozen=True)
class Operation:
    operator: str
    arguments: tuple


@dataclass(frozen=True)
class StructuredQuery:
    query: str
    filter: Comparison | Operation | None = None
    limit: int | None = None


_TOKEN = re.compile(
    r"""\s*(?:(?P<time>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)|(?P<date>\d{4}-\d{2}-\d{2})|(?P<number>[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<mark>[()\[\],]))"""
)


def _tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the filter from {text[at:at + 20]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*found, ("end", "")]


class _Parser:
    def __init__(self, text: str, attributes: Iterable[str] | None, comparators: Iterable[str], operators: Iterable[str]):
        self.tokens, self.at = _tokens(text), 0
        self.attributes, self.comparators, self.operators = attributes and set(attributes), set(comparators), set(operators)

    def take(self, kind: str | None = None, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if kind and token[0] != kind or value and token[1] != value:
            raise ValueError(f"expected {value or kind}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def call(self) -> Comparison | Operation:
        name = self.take("name")[1].lower()
        self.take("mark", "(")
        args = []
        while self.tokens[self.at] != ("mark", ")"):
            args.append(self.argument())
            if self.tokens[self.at] != ("mark", ")"):
                self.take("mark", ",")
        self.take()
        if name in self.operators:
            if not args or not all(isinstance(a, Comparison | Operation) for a in args) or name == "not" and len(args) != 1:
                raise ValueError(f"bad arguments of {name}")
            return args[0] if len(args) == 1 and name != "not" else Operation(name, tuple(args))
        if name in self.comparators:
            if len(args) != 2 or not isinstance(args[0], str):
                raise ValueError(f"{name} takes an attribute and a value")
            if self.attributes is not None and args[0] not in self.attributes:
                raise ValueError(f"unknown attribute {args[0]!r}")
            return Comparison(name, args[0], args[1])
        raise ValueError(f"unknown function {name!r}")

    def argument(self):
        kind, text = self.tokens[self.at]
        if kind == "name" and text.lower() not in ("true", "false"):
            return self.call()
        if (kind, text) == ("mark", "["):
            self.take()
            items = []
            while self.tokens[self.at] != ("mark", "]"):
                items.append(self.argument())
                if self.tokens[self.at] != ("mark", "]"):
                    self.take("mark", ",")
            self.take()
            return items
        self.take()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "number":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "date":
            return datetime.date.fromisoformat(text)
        if kind == "time":
            return datetime.datetime.fromisoformat(text.removesuffix("Z")).replace(tzinfo=datetime.UTC)
        if kind == "name":
            return text.lower() == "true"
        raise ValueError(f"unexpected {text or 'end'!r}")


def parse(text: str, *, attributes: Iterable[str] | None = None, comparators: Iterable[str] = COMPARATORS, operators: Iterable[str] = OPERATORS) -> Comparison | Operation:
    p = _Parser(text, attributes, comparators, operators)
    found = p.call()
    p.take("end")
    return found


def prune(node, *, attributes: Iterable[str] | None = None, comparators: Iterable[str] = COMPARATORS, operators: Iterable[str] = OPERATORS):
    """The filter without what isn't allowed; None if nothing is left."""
    if isinstance(node, Comparison):
        return node if node.comparator in comparators and (attributes is None or node.attribute in attributes) else None
    if node is None or node.operator not in operators:
        return None
    args = tuple(a for a in (prune(x, attributes=attributes, comparators=comparators, operators=operators) for x in node.arguments) if a is not None)
    if not args:
        return None
    return args[0] if len(args) == 1 and node.operator != "not" else Operation(node.operator, args)


def to_column(node: Comparison | Operation | None) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Operation):
        parts = [to_column(a) for a in node.arguments]
        return ~parts[0] if node.operator == "not" else reduce((lambda a, b: a & b) if node.operator == "and" else (lambda a, b: a | b), parts)
    c, v = F.col(node.attribute), node.value
    many = v if isinstance(v, list) else [v]
    return {
        "eq": lambda: c == F.lit(v), "ne": lambda: c != F.lit(v), "gt": lambda: c > F.lit(v), "gte": lambda: c >= F.lit(v), "lt": lambda: c < F.lit(v), "lte": lambda: c <= F.lit(v),
        "contain": lambda: F.contains(c, F.lit(v)), "like": lambda: c.like(v), "in": lambda: c.isin(many), "nin": lambda: ~c.isin(many),
    }[node.comparator]()


def where(df: DataFrame, expression: str) -> DataFrame:
    """df cut by an expression over its own columns."""
    return df.where(to_column(parse(expression, attributes=df.columns)))


_DICT = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$in": "in", "$nin": "nin", "$contains": "contain"}


def from_dict(filter_: dict, prefix: str = "") -> Column:
    """Equalities by key, all of them; nested keys by struct path, lists as membership, $and / $or / $not and {"$gt": 1} forms."""
    parts = []
    for k, v in filter_.items():
        if k in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), [from_dict(x, prefix) for x in v]))
        elif k == "$not":
            parts.append(~from_dict(v, prefix))
        elif isinstance(v, dict) and v and all(x.startswith("$") for x in v):
            parts += [~F.contains(F.col(prefix + k), F.lit(y)) if x == "$not_contains" else to_column(Comparison(_DICT[x], prefix + k, y)) for x, y in v.items()]
        elif isinstance(v, dict):
            parts.append(from_dict(v, f"{prefix}{k}."))
        elif isinstance(v, list):
            parts.append(reduce(lambda a, b: a & b, [F.array_contains(F.col(prefix + k), F.lit(x)) for x in v], F.lit(True)))
        else:
            parts.append(F.col(prefix + k) == F.lit(v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


_REQUEST = re.compile(r"(\w+):(\w+)(?:\[(.+)\])?")
#: reducers of the frame query language
REDUCERS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev, "var": F.variance, "median": F.median, "nunique": F.count_distinct}


def frame_query(df: DataFrame, request: str, order: str) -> DataFrame:
    """``column:c``, ``row:2``, ``mean:c``, each with ``[1..3]``, ``[0,2]`` (rows by their place in ``order``) or ``[a,b]`` (columns, for a row)."""
    m = _REQUEST.fullmatch(request.strip())
    if not m:
        raise ValueError(f"bad request {request!r}")
    what, name, part = m.groups()
    places = names = None
    if part and (r := re.fullmatch(r"(\d+)\.\.(\d+)", part)):
        places = F.col("__row").between(int(r[1]), int(r[2]))
    elif part and re.fullmatch(r"\d+(,\s*\d+)*", part):
        places = F.col("__row").isin([int(x) for x in part.split(",")])
    elif part:
        names = [x.strip() for x in part.split(",")]
    rows = numbered(df, [order], "__row") if what == "row" or places is not None else df
    if what == "row":
        if unknown := set(names or []) - set(df.columns):
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return rows.where(F.col("__row") == int(name)).select(*(names or df.columns))
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}")
    rows = rows if places is None else rows.where(places)
    if what == "column":
        return rows.select(order, name) if name != order else rows.select(name)
    if what not in REDUCERS:
        raise ValueError(f"unknown operation {what!r}")
    return (df if places is None else rows).agg(REDUCERS[what](name).alias(what))


NO_FILTER = "NO_FILTER"


def from_answer(answer: str, attributes: Iterable[str] | None = None) -> StructuredQuery:
    """A query, filter and limit from a model's JSON answer (bare or fenced). An empty query is a space; NO_FILTER means none."""
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", answer, re.S)
    given = json.loads(fence[1] if fence else answer)
    text, expression, limit = given.get("query") or " ", given.get("filter"), given.get("limit")
    found = None if not expression or expression == NO_FILTER else parse(expression, attributes=list(attributes) if attributes is not None else None)
    return StructuredQuery(text, found, int(limit) if limit is not None else None)


def self_query(rows: DataFrame, queries: DataFrame, asked: StructuredQuery, k: int = 4, **how) -> DataFrame:
    """Nearest rows among those that the structured query's filter lets through; its limit goes before k."""
    from docloom.operators import search

    return search.top_k(rows, queries, k=k if asked.limit is None else asked.limit, where=None if asked.filter is None else to_column(asked.filter), **how)
