"""Operators on DataFrames: pipe, fan out, assign, pick, branch, route, map, retry, fall back, with errors kept in columns.

A node is a function from DataFrame to DataFrame; ``Node`` adds composition by ``|``. Everything is lazy, so a chain of nodes is
one plan that Spark optimises as a whole.
"""

from __future__ import annotations

import inspect
import json
import time
import typing
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import stored


class Node:
    """A named DataFrame function. ``a | b`` runs a, then b; a dict of nodes is a fan-out."""

    def __init__(self, f: Callable[[DataFrame], DataFrame], name: str | None = None, parts: tuple[Node, ...] = ()):
        self.f, self.name, self.parts = f, name or getattr(f, "__name__", "node"), parts

    def __call__(self, df: DataFrame, **how) -> DataFrame:
        return self.f(df, **how)

    def __or__(self, other: NodeLike) -> Node:
        return pipe(self, other)

    def __ror__(self, other: NodeLike) -> Node:
        return pipe(other, self)

    def bind(self, **how) -> Node:
        """With some arguments given."""
        return Node(lambda df, **more: self.f(df, **how | more), self.name)

    def graph(self) -> list[tuple[str, str]]:
        """Edges between the parts of a chain."""
        names = [p.name for p in self.parts] or [self.name]
        return list(zip(names, names[1:], strict=False))

    def schema(self, df: DataFrame) -> str:
        """The output schema for an input, as JSON; nothing runs."""
        return self(df).schema.json()


NodeLike = Node | Callable[[DataFrame], DataFrame] | dict


def node(thing: NodeLike) -> Node:
    if isinstance(thing, Node):
        return thing
    if isinstance(thing, dict):
        return fan_out(**thing)
    if callable(thing):
        return Node(thing)
    raise TypeError(f"{thing!r} isn't an operator")


def pipe(*things: NodeLike) -> Node:
    parts: list[Node] = []
    for n in map(node, things):
        parts += n.parts or (n,)
    return Node(lambda df, **how: reduce(lambda d, p: p(d), parts[1:], parts[0](df, **how)), "pipe", tuple(parts))


def assign(**columns: Column | Callable[[DataFrame], Column]) -> Node:
    """Adds or replaces columns; all are computed from the input row."""
    return Node(lambda df: df.withColumns({k: v(df) if callable(v) else v for k, v in columns.items()}), "assign")


def pick(*names: str) -> Node:
    """The named columns that are there; none of them is an error."""

    def f(df: DataFrame) -> DataFrame:
        have = [n for n in names if n in df.columns]
        if not have:
            raise ValueError(f"no column of {names}")
        return df.select(*have)

    return Node(f, "pick")


def fan_out(**branches: Column | Callable[[DataFrame], Column]) -> Node:
    """One output column for each branch, all of the same input row."""
    return Node(lambda df: df.select(*((v(df) if callable(v) else v).alias(k) for k, v in branches.items())), "fan_out")


def branch(*cases: tuple[Column, Column], default: Column) -> Column:
    """The value of the first case that is true."""
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])).otherwise(default) if cases else default


def route(key: Column | str, routes: dict[str, Column], default: Column | None = None) -> Column:
    """The column named by a key; an unknown key is an error unless there is a default."""
    k = F.col(key) if isinstance(key, str) else key
    other = default if default is not None else F.raise_error(F.concat(F.lit("no route for key "), F.coalesce(k.cast("string"), F.lit("null"))))
    return branch(*((k == name, value) for name, value in routes.items()), default=other)


def each(array: Column | str, f: Callable[[Column], Column]) -> Column:
    return F.transform(array, f)


def first_that_works(*attempts: Column) -> Column:
    """The first attempt (try_... expressions) that isn't null."""
    return F.coalesce(*attempts)


def caught(f: Callable, returns: str, *, attempts: int = 1, retry_on: tuple[type[Exception], ...] = (Exception,), wait: float = 0.0, factor: float = 2.0, fallbacks: tuple[Callable, ...] = ()) -> Callable[..., Column]:
    """f as a column function that gives struct<value, error>: failed rows keep their error and don't stop the others.

    Each row is tried ``attempts`` times with growing waits, then each fallback once. Later steps can pass failed rows over
    with ``ok``. null inputs are passed to f.
    """

    @F.pandas_udf(f"value {returns}, error string, attempts int")
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for args in zip(*columns, strict=True):
            value = error = None
            n = 0
            for attempt in range(attempts):
                n += 1
                try:
                    value, error = f(*args), None
                    break
                except retry_on as e:
                    error = f"{type(e).__name__}: {e}"
                    if wait and attempt + 1 < attempts:
                        time.sleep(wait * factor**attempt)
                except Exception as e:  # not to be tried again
                    error = f"{type(e).__name__}: {e}"
                    break
            for other in fallbacks if error else ():
                n += 1
                try:
                    value, error = other(*args), None
                    break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((value, error, n))
        return pd.DataFrame(rows, columns=["value", "error", "attempts"])

    return run


def ok(result: str) -> Column:
    return F.col(f"{result}.error").isNull()


#: Spark types of Python annotations
TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def spark_type(hint: object) -> T.DataType:
    """The Spark type of a type hint: scalars, list[...], dict[...] and X | None."""
    if hint in TYPES:
        return TYPES[hint]
    origin, args = typing.get_origin(hint), [a for a in typing.get_args(hint) if a is not type(None)]
    if origin is list:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if len(args) == 1:
        return spark_type(args[0])
    raise TypeError(f"no Spark type for {hint!r}")


class Tool:
    """A Python function with a schema from its signature, callable on columns and, once registered, from SQL."""

    def __init__(self, f: Callable, name: str | None = None):
        hints = typing.get_type_hints(f)
        self.f, self.name, self.description = f, name or f.__name__, inspect.getdoc(f) or ""
        self.arguments = {p: hints[p] for p in inspect.signature(f).parameters}
        self.returns = spark_type(hints["return"])

    def schema(self) -> dict:
        """A JSON schema of the arguments."""
        kinds = {"string": "string", "bigint": "integer", "double": "number", "boolean": "boolean"}
        needed = [n for n, p in inspect.signature(self.f).parameters.items() if p.default is p.empty]
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": {n: {"type": kinds.get(spark_type(h).simpleString(), "object")} for n, h in self.arguments.items()}, "required": needed}}

    def __call__(self, *columns: Column | str) -> Column:
        f = self.f

        @F.pandas_udf(self.returns)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([f(*args) for args in zip(*series, strict=True)], dtype=object)

        return run(*columns)

    def register(self, spark: SparkSession) -> None:
        """Makes it a function of SQL, over batches of rows as well."""
        f = self.f

        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([f(*args) for args in zip(*series, strict=True)], dtype=object)

        spark.udf.register(self.name, F.pandas_udf(run, self.returns, F.PandasUDFType.SCALAR))


def tool(f: Callable) -> Tool:
    return Tool(f)


class ChainTool:
    """An operator that is called like a tool: from a table of calls with JSON arguments to a table of answers."""

    def __init__(self, thing: NodeLike, arguments: str, *, name: str | None = None, description: str = "", optional: tuple[str, ...] = ()):
        self.node, self.arguments, self.optional = node(thing), T.StructType.fromDDL(arguments), optional
        self.name, self.description = name or self.node.name, description

    def schema(self) -> dict:
        """A JSON schema of the arguments."""

        def shape(kind: T.DataType) -> dict:
            if isinstance(kind, T.ArrayType):
                return {"type": "array", "items": shape(kind.elementType)}
            if isinstance(kind, T.StructType):
                return {"type": "object", "properties": {f.name: shape(f.dataType) for f in kind}}
            return {"type": {"string": "string", "boolean": "boolean", "int": "integer", "bigint": "integer"}.get(kind.simpleString(), "number" if isinstance(kind, T.NumericType) else "string")}

        return {"name": self.name, "description": self.description, "parameters": {**shape(self.arguments), "required": [f.name for f in self.arguments if f.name not in self.optional]}}

    def __call__(self, calls: DataFrame, *, key: str = "call_id", args: str = "args") -> DataFrame:
        """key, content (the columns that the operator adds, as JSON; null if it drops the row) and error (null if it ran).

        Arguments that aren't a JSON object of the right types, or lack one that isn't optional, are an error of their call alone.
        """
        rows = stored(calls.select(key, F.from_json(args, self.arguments, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("a"), F.col(args).alias("__args")), "calls")
        wrong = F.when(F.get_json_object("__args", "$").isNull(), "the arguments aren't JSON")
        for f in self.arguments:
            given = F.get_json_object("__args", f"$.{f.name}")
            if f.name not in self.optional:
                wrong = wrong.when(given.isNull(), f"{f.name} is missing")
            wrong = wrong.when(given.isNotNull() & F.col("a")[f.name].isNull(), f"{f.name} is no {f.dataType.simpleString()}")
        marked = rows.withColumn("error", wrong)
        made = self.node(marked.where("error IS NULL").select(key, "a.*"))
        more = [c for c in made.columns if c != key and c not in self.arguments.fieldNames()]
        done = made.select(F.col(key), F.to_json(F.struct(*more)).alias("content"))
        return marked.select(key, "error").join(done, key, "left").select(key, "content", "error")


def cyclic_responses(responses: list[str], number: Column | str) -> Column:
    """A stand-in for a model: the responses in turn, by row number from 0."""
    return F.get(F.array(*map(F.lit, responses)), F.pmod(number, F.lit(len(responses))).cast("int"))


def select_only(spark: SparkSession, sql: str, tables: list[str] | None = None) -> DataFrame:
    """Runs one SELECT (or WITH ... SELECT) statement; anything else is an error. tables: all that it may read, for statements
    that a model has made; then paths, other tables and table functions are errors, too."""
    body = sql.strip().rstrip(";")
    if not body.upper().startswith(("SELECT", "WITH")) or ";" in body:
        raise ValueError("only a single SELECT is allowed")
    # spark.sql runs a command at once, so the statement is parsed first
    todo, kind = [spark._jsparkSession.sessionState().sqlParser().parsePlan(body)], spark._jvm.java.lang.Class.forName
    wrong = [kind(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement", "V2WriteCommand")]
    own, read = set(), set()  # names that the statement gives, and names it asks for
    while todo:
        plan = todo.pop()
        if any(k.isInstance(plan) for k in wrong):
            raise ValueError("only a single SELECT is allowed")
        name = plan.getClass().getSimpleName()
        if name == "UnresolvedWith":
            own |= {t._1().lower() for t in _items(plan.cteRelations())}
            todo += [t._2() for t in _items(plan.cteRelations())]
        elif name == "UnresolvedRelation":
            read.add(".".join(_items(plan.multipartIdentifier())).lower())
        elif name == "UnresolvedTableValuedFunction" and tables is not None:
            raise ValueError("table functions aren't allowed")
        inner = [*_items(plan.children()), *_items(plan.innerChildren())]
        todo += [p for p in inner if kind("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(p)]
    if tables is not None and (more := read - own - {t.lower() for t in tables}):
        raise ValueError(f"not allowed to read {sorted(more)}")
    return spark.sql(body)


def _items(seq) -> list:
    """The items of a Scala sequence."""
    return [seq.apply(i) for i in range(seq.size())]


def table_info(spark: SparkSession, tables: list[str]) -> str:
    """Schemas of tables as text, for prompts."""
    return "\n".join(f"{t}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.table(t).schema)})" for t in tables)


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def merged_config(*configs: dict | None) -> dict:
    """Configurations merged: tags united, metadata and other dicts merged, later values win."""
    out: dict = {}
    for c in filter(None, configs):
        for k, v in c.items():
            out[k] = sorted({*out.get(k, ()), *v}) if k == "tags" else out.get(k, {}) | v if isinstance(v, dict) else v
    return json.loads(json.dumps(out))


def generator(f: Callable[[dict], typing.Iterable[dict]], schema: str) -> Node:
    """A Python generator from a row to rows as a node: one input row gives any number of output rows. Works on streams."""

    def run(df: DataFrame) -> DataFrame:
        names = T.StructType.fromDDL(schema).names

        def rows(batches):
            for part in batches:
                yield pd.DataFrame([x for row in part.to_dict("records") for x in f(row)], columns=names)

        return df.mapInPandas(rows, schema)

    return Node(run, getattr(f, "__name__", "generator"))


def dumped(name: str, **how) -> str:
    """A node's name and arguments as JSON; only plain values can be arguments."""
    return json.dumps({"node": name, "how": how}, sort_keys=True)


def loaded(text: str, known: dict[str, Callable[..., NodeLike]]) -> Node:
    """The node that ``dumped`` has written, made by the function of that name; names that aren't known are an error, and nothing else runs."""
    spec = json.loads(text)
    if spec.get("node") not in known:
        raise ValueError(f"no node {spec.get('node')!r}")
    return node(known[spec["node"]](**spec.get("how", {})))
