"""Partial outputs and run logs: cumulative texts and values of streamed chunks, JSON patches, event logs."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.folds import folded
from docloom.streaming.incremental import JsonPieces, XmlPieces


def _places(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def _pointer(parts: tuple) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def difference(old: object, new: object, at: tuple = ()) -> list[dict]:
    """JSON patch operations (RFC 6902) that make new of old."""
    if type(old) is type(new) and isinstance(old, dict):
        ops = [{"op": "remove", "path": _pointer((*at, k))} for k in old if k not in new]
        for k, v in new.items():
            ops += difference(old[k], v, (*at, k)) if k in old else [{"op": "add", "path": _pointer((*at, k)), "value": v}]
        return ops
    if type(old) is type(new) and isinstance(old, list):
        ops = [op for i, (a, b) in enumerate(zip(old, new, strict=False)) for op in difference(a, b, (*at, i))]
        ops += [{"op": "remove", "path": _pointer((*at, i))} for i in range(len(old) - 1, len(new) - 1, -1)]
        return ops + [{"op": "add", "path": _pointer((*at, "-")), "value": v} for v in new[len(old) :]]
    return [] if old == new and type(old) is type(new) else [{"op": "replace", "path": _pointer(at), "value": new}]


def patched(value: object, ops: list[dict]) -> object:
    """A value after patch operations: add, replace and remove. A path that isn't there is an error."""
    return applied(copy.deepcopy(value), ops)


def applied(value: object, ops: list[dict]) -> object:
    """The same on the value itself, which is changed."""
    for op in ops:
        if op["op"] not in ("add", "replace", "remove"):
            raise ValueError(f"unknown operation {op['op']!r}")
        parts = _places(op["path"])
        if not parts:
            value = copy.deepcopy(op.get("value"))
            continue
        to = value
        for p in parts[:-1]:
            to = to[int(p)] if isinstance(to, list) else to[p]
        last = parts[-1]
        if isinstance(to, list):
            i = len(to) if last == "-" else int(last)
            if op["op"] == "add":
                to.insert(i, copy.deepcopy(op["value"]))
            elif op["op"] == "replace":
                to[i] = copy.deepcopy(op["value"])
            else:
                del to[i]
        elif op["op"] == "remove":
            del to[last]
        else:
            to[last] = copy.deepcopy(op["value"])
    return value


class _Text:
    """The text so far."""

    def __init__(self, text: str = ""):
        self.text = text

    def step(self, seq: object, text: str | None) -> list[tuple]:
        self.text += text or ""
        return [(seq, text, self.text)]

    def end(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return self.text

    load = classmethod(lambda cls, text: cls(text))


def cumulative_text(chunks: DataFrame, *, run: str = "run_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """run, seq, text and so_far: each chunk with the text of its run up to it. Also of a stream, whose state is that text."""
    return folded(chunks, _Text, f"`{seq}` {dict(chunks.dtypes)[seq]}, `{text}` string, so_far string", by=run, order=[seq], values=[seq, text])


class _Patches:
    """Patches of JSON in pieces."""

    def __init__(self, pieces: JsonPieces | None = None):
        self.pieces = pieces or JsonPieces()

    def step(self, seq: object, text: str | None) -> list[tuple]:
        ops = self.pieces.feed(text)
        return [(seq, json.dumps(ops))] if ops else []

    def end(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return self.pieces.dump()

    load = classmethod(lambda cls, text: cls(JsonPieces.load(text)))


class _Values(_Patches):
    """Values of JSON in pieces; the state holds the value so far."""

    def __init__(self, pieces: JsonPieces | None = None, value: object = None):
        super().__init__(pieces)
        self.value = value

    def step(self, seq: object, text: str | None) -> list[tuple]:
        ops = self.pieces.feed(text)
        self.value = applied(self.value, ops)
        return [(seq, json.dumps(self.value))] if ops else []

    def dump(self) -> str:
        return json.dumps([self.pieces.dump(), self.value])

    @classmethod
    def load(cls, text: str) -> _Values:
        pieces, value = json.loads(text)
        return cls(JsonPieces.load(pieces), value)


def cumulative_values(chunks: DataFrame, *, run: str = "run_id", seq: str = "seq", text: str = "text", diff: bool = False) -> DataFrame:
    """run, seq and value (JSON): what the chunks so far parse to, where that has changed; with diff, the patch from the value before.

    Also of a stream. Each chunk is read once, by ``JsonPieces``; with diff, what is kept of a run is its open brackets and a tail.
    """
    return folded(chunks, _Patches if diff else _Values, f"`{seq}` {dict(chunks.dtypes)[seq]}, value string", by=run, order=[seq], values=[seq, text])


class _Log:
    """The state that patches lead to."""

    def __init__(self, state: object = None, n: int = 0):
        self.state, self.n = state, n

    def step(self, text: str | None) -> list[tuple]:
        self.state, self.n = applied(self.state, json.loads(text) if text else []), self.n + 1
        return []

    def end(self) -> list[tuple]:
        return [(json.dumps(self.state, sort_keys=True), self.n)]

    def dump(self) -> str:
        return json.dumps([self.state, self.n])

    load = classmethod(lambda cls, text: cls(*json.loads(text)))


def folded_log(patches: DataFrame, *, run: str = "run_id", seq: str = "seq", ops: str = "ops") -> DataFrame:
    """run, state (JSON) and n: the state that each run's patches (JSON arrays of operations) lead to, in order. Of a stream, after each micro-batch."""
    return folded(patches, _Log, "state string, n long", by=run, order=[seq], values=[ops])


KINDS = ("chain", "chat_model", "llm", "tool", "retriever", "prompt", "parser")


def event_log(runs: DataFrame, *, run: str = "run_id", parent: str = "parent_id", kind: str = "kind", name: str = "name", started: str = "started", ended: str = "ended", error: str = "error", tags: str = "tags", chunks: DataFrame | None = None) -> DataFrame:
    """Events of runs, two for each: on_{kind}_start and on_{kind}_end (or _error), and on_{kind}_stream for each chunk (run_id, ts, text).

    Columns: ts, event, run_id, parent_id, name, tags, data. Sort by ts and event to replay; works on streams as well, as rows are only unfolded.
    """
    base = [F.col(run).alias("run_id"), F.col(parent).alias("parent_id"), F.col(name).alias("name"), F.col(tags).alias("tags")]
    event = lambda what: F.concat(F.lit("on_"), F.col(kind), F.lit("_"), what)
    end = F.when(F.col(error).isNull(), F.lit("end")).otherwise(F.lit("error"))
    both = F.array(
        F.struct(F.col(started).alias("ts"), event(F.lit("start")).alias("event"), F.lit(None).cast("string").alias("data")),
        F.struct(F.col(ended).alias("ts"), event(end).alias("event"), F.col(error).cast("string").alias("data")),
    )
    rows = runs.select(*base, F.explode(F.filter(both, lambda e: e["ts"].isNotNull())).alias("e"))
    out = rows.select("e.ts", "e.event", "run_id", "parent_id", "name", "tags", "e.data")
    if chunks is not None:
        said = chunks.select(F.col("run_id").alias("__run"), "ts", F.col("text").alias("data"))
        more = said.join(runs, F.col("__run") == F.col(run)).select("ts", event(F.lit("stream")).alias("event"), *base, "data")
        out = out.unionByName(more)
    return out


def wanted(events: DataFrame, *, names: list[str] | None = None, types: list[str] | None = None, tags: list[str] | None = None, not_names: list[str] | None = None, not_types: list[str] | None = None, not_tags: list[str] | None = None) -> DataFrame:
    """Events that one of the include lists has (all, without any) and no exclude list; a type is the middle of an event's name."""
    kind = F.regexp_extract("event", "^on_(.*)_[a-z]+$", 1)
    some = lambda n, t, g: [c for given, c in ((n, F.col("name").isin(n or [])), (t, kind.isin(t or [])), (g, F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, g or [""]))))) if given]
    keep, drop = some(names, types, tags), some(not_names, not_types, not_tags)
    condition = F.lit(not keep)
    for c in keep:
        condition = condition | F.coalesce(c, F.lit(False))
    for c in drop:
        condition = condition & ~F.coalesce(c, F.lit(False))
    return events.where(condition)


def branches(stream: DataFrame, **made: Column) -> DataFrame:
    """One stream's rows through several branches at once: branch and value (string), all of the same input row. Works on streams."""
    return stream.select(*stream.columns, F.explode(F.array(*(F.struct(F.lit(n).alias("branch"), c.cast("string").alias("value")) for n, c in made.items()))).alias("__b")).select(*stream.columns, "__b.branch", "__b.value")


class _Xml:
    """Leaf elements of XML in pieces."""

    def __init__(self, pieces: XmlPieces | None = None, n: int = 0):
        self.pieces, self.n = pieces or XmlPieces(), n

    def step(self, seq: object, text: str | None) -> list[tuple]:
        found = self.pieces.feed(text)
        self.n += len(found)
        return [(seq, self.n - len(found) + i, path, value) for i, (path, value) in enumerate(found)]

    def end(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return json.dumps([self.pieces.dump(), self.n])

    @classmethod
    def load(cls, text: str) -> _Xml:
        pieces, n = json.loads(text)
        return cls(XmlPieces.load(pieces), n)


def xml_elements(chunks: DataFrame, *, run: str = "run_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """run, seq, item_no, path and value: the leaf elements of XML in chunks, each with the chunk that closes it. Also of a stream.
    Reading ends at the first error; documents with a doctype have none."""
    return folded(chunks, _Xml, f"`{seq}` {dict(chunks.dtypes)[seq]}, item_no int, path string, value string", by=run, order=[seq], values=[seq, text])


def collected(events: DataFrame, *, run: str = "run_id", order: str = "ts") -> DataFrame:
    """run, events (array of structs in order) and n: all that was traced of each run."""
    rest = [c for c in events.columns if c not in (run, order)]
    return events.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("events"), F.count("*").alias("n"))
