"""Settings of operators at run time: fields and alternatives chosen by a configuration, listeners, and pictures of chains."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docloom.operators.algebra import Node, NodeLike, node


@dataclass(frozen=True)
class Field:
    """A setting: its id, type and default."""

    id: str
    kind: type
    default: object = None

    def value(self, config: dict) -> object:
        given = config.get(self.id, self.default)
        if given is not None and not isinstance(given, self.kind):
            raise ValueError(f"{self.id} has to be {self.kind.__name__}, not {given!r}")
        return given


def unique(fields: list[Field]) -> list[Field]:
    """Each field once, in order of id; two different ones of an id are an error."""
    found: dict[str, Field] = {}
    for f in fields:
        if found.setdefault(f.id, f) != f:
            raise ValueError(f"conflicting fields of id {f.id!r}")
    return [found[i] for i in sorted(found)]


def configurable(make: Callable[..., NodeLike], *fields: Field) -> Callable[[dict], Node]:
    """A node made anew from a configuration: config -> node. Unknown settings are an error."""
    known = unique(list(fields))

    def build(config: dict) -> Node:
        if strange := set(config) - {f.id for f in known}:
            raise ValueError(f"unknown settings {sorted(strange)}")
        return node(make(**{f.id: f.value(config) for f in known}))

    return build


def alternatives(which: str, default: str, **choices: NodeLike) -> Callable[[dict], Node]:
    """One of several nodes by a setting: config -> node."""

    def build(config: dict) -> Node:
        name = config.get(which, default)
        if name not in choices:
            raise ValueError(f"{which} {name!r} isn't one of {sorted(choices)}")
        return node(choices[name])

    return build


def listened(thing: NodeLike, *, on_start: Callable[[dict], None] | None = None, on_end: Callable[[dict], None] | None = None, on_error: Callable[[dict], None] | None = None) -> Node:
    """A node that tells listeners of each run: its name, start, end and, if it fails, its error, which is raised. A run is the building of the plan."""
    inner = node(thing)

    def f(df: DataFrame, **how) -> DataFrame:
        run = {"name": inner.name, "started": time.time(), "columns": df.columns}
        if on_start:
            on_start(dict(run))
        try:
            out = inner(df, **how)
        except Exception as e:
            if on_error:
                on_error(run | {"ended": time.time(), "error": repr(e)})
            raise
        if on_end:
            on_end(run | {"ended": time.time(), "output": out.columns})
        return out

    return Node(f, inner.name)


def mermaid(edges: list[tuple[str, str]]) -> str:
    """A chain's edges as a Mermaid flow chart."""
    names = list(dict.fromkeys(x for e in edges for x in e))
    number = {n: f"n{i}" for i, n in enumerate(names)}
    quoted = lambda n: '"' + n.replace('"', "#quot;") + '"'
    return "\n".join(["graph TD;", *(f"  {number[n]}[{quoted(n)}];" for n in names), *(f"  {number[a]} --> {number[b]};" for a, b in edges)])


def drawn(edges: list[tuple[str, str]]) -> str:
    """A chain's edges as boxes under each other, for a terminal; branches are listed as arrows."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    starts = [a for a in after if all(a != b for _, b in edges)]
    out, todo, seen = [], list(reversed(starts)), set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        line = "-" * (len(n) + 2)
        out += [f"+{line}+", f"| {n} |", f"+{line}+", *(f"  -> {b}" for b in after.get(n, ()))]
        todo += reversed(after.get(n, ()))
    return "\n".join(out)
