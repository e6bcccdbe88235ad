"""Prompts: mustache templates, chat prompts as arrays of messages, few-shot prompts."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.columns import ColumnOrName, col
from docloom.functions.parsers import yaml_to_json
from docloom.functions.text import template, template_fields

MESSAGES = "array<struct<role:string,text:string>>"
_TAG = re.compile(r"\{\{(\{[^{}]+\}|[#^/!&>]?[^{}]*)\}\}\}?")


def parsed_mustache(text: str) -> list:
    """The parts of a mustache template: text, and (kind, name, parts) of tags. Tags that aren't closed are an error; so are partials."""
    stack: list[tuple[str, str, list]] = [("", "", [])]
    at = 0
    for m in _TAG.finditer(text):
        body = m[1]
        kind, name = ("&", body[1:-1].strip()) if body[:1] == "{" else (body[0], body[1:].strip()) if body[:1] in "#^/!&>" and body else ("", body.strip())
        lead, rest = text[at : m.start()], m.end()
        if kind in ("#", "^", "/", "!"):  # a tag alone on its line takes the line's end with it
            line = re.search(r"(?:\A|\n)[ \t]*\Z", text[: m.start()])
            after = re.match(r"[ \t]*(?:\r?\n|\Z)", text[rest:])
            if line and after:
                lead, rest = lead.rstrip(" \t"), rest + after.end()
        stack[-1][2].append(lead)
        at = rest
        if kind in ("#", "^"):
            stack.append((kind, name, []))
        elif kind == "/":
            opened = stack.pop()
            if opened[1] != name or not stack:
                raise ValueError(f"section {name!r} is closed but not open")
            stack[-1][2].append(opened)
        elif kind == ">":
            raise ValueError("partials aren't supported")
        elif kind != "!":
            stack[-1][2].append((kind, name, []))
    if len(stack) > 1:
        raise ValueError(f"section {stack[-1][1]!r} isn't closed")
    stack[0][2].append(text[at:])
    return stack[0][2]


def _found(name: str, scopes: list) -> object:
    if name == ".":
        return scopes[-1]
    first, *rest = name.split(".")
    for scope in reversed(scopes):
        if isinstance(scope, dict) and first in scope:
            value = scope[first]
            for part in rest:
                value = value.get(part) if isinstance(value, dict) else None
            return value
    return None


def rendered(parts: list, scopes: list) -> str:
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        kind, name, inner = part
        value = _found(name, scopes)
        if kind in ("", "&"):
            text = "" if value is None else value if isinstance(value, str) else json.dumps(value)
            out.append(text if kind else html.escape(text))
        elif kind == "^":
            out.append(rendered(inner, scopes) if not value else "")
        elif value:
            out += [rendered(inner, [*scopes, x]) for x in (value if isinstance(value, list) else [value])]
    return "".join(out)


def mustache_fields(text: str) -> list[str]:
    """Names that a mustache template asks for at its top level, in order."""
    return list(dict.fromkeys(p[1] for p in parsed_mustache(text) if not isinstance(p, str)))


def mustache(text: str, values: ColumnOrName) -> Column:
    """A mustache template filled from a struct or map column: variables (escaped; & and triple braces as they are), sections, inverted sections, comments, dotted names."""
    parts = parsed_mustache(text)

    @F.pandas_udf("string")
    def fill(x: pd.Series) -> pd.Series:
        return pd.Series([rendered(parts, [json.loads(v) if v else {}]) for v in x], dtype=object)

    return fill(F.to_json(col(values)))


def chat(*messages: tuple[str, str] | Column | str, **values: ColumnOrName) -> Column:
    """An array of messages: (role, template) pairs, and columns of messages (a name or a column) in their places."""
    parts = []
    for m in messages:
        if isinstance(m, tuple):
            parts.append(F.array(F.struct(F.lit(m[0]).alias("role"), template(m[1], **values).alias("text"))).cast(MESSAGES))
        else:
            parts.append(F.coalesce(col(m).cast(MESSAGES), F.array().cast(MESSAGES)))
    return F.concat(*parts)


def chat_fields(*messages: tuple[str, str] | str) -> list[str]:
    """Names of the fields and of the message columns that a chat prompt asks for, in order."""
    return list(dict.fromkeys(n for m in messages for n in (template_fields(m[1]) if isinstance(m, tuple) else [m])))


def few_shot(examples: ColumnOrName, each: str, suffix: str, prefix: str = "", separator: str = "\n\n", **values: ColumnOrName) -> Column:
    """A prompt of a prefix, examples (an array of structs, by a template) and a suffix."""

    def one(e: Column) -> Column:
        return template(each, **{n: e[n] for n in template_fields(each)})

    shown = F.transform(F.coalesce(col(examples), F.array()), one)
    ends = [template(t, **values) for t in (prefix, suffix)]
    parts = F.concat(F.array(ends[0]) if prefix else F.array().cast("array<string>"), shown, F.array(ends[1]))
    return F.array_join(parts, separator)


def loaded(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Prompt templates from JSON or YAML files (a folder or a glob): path, name, template, fields and error.

    A file has ``template`` (or, for a few-shot prompt, ``prefix`` and ``suffix``) and may have ``_type`` (``prompt`` or
    ``few_shot``), ``template_format`` (f-string, the only one that is let in from a file) and ``input_variables``, which have to
    be the fields that the template asks for. What is wrong with a file is its error; templates of paths (``template_path``) are refused.
    """
    body = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    text = yaml_to_json("value") if kind == "yaml" else F.col("value")
    shape = "_type string, template string, prefix string, suffix string, template_format string, template_path string, input_variables array<string>"
    rows = body.select("path", F.from_json(text, shape).alias("v")).select("path", "v.*")

    @F.pandas_udf("array<string>")
    def fields(texts: pd.Series) -> pd.Series:
        return pd.Series([_fields(t) for t in texts], dtype=object)

    whole = F.when(F.coalesce("_type", F.lit("prompt")) == "few_shot", F.concat(F.coalesce("prefix", F.lit("")), F.lit("\n\n"), F.coalesce("suffix", F.lit("")))).otherwise(F.col("template"))
    rows = rows.withColumn("whole", whole).withColumn("fields", fields("whole"))
    error = (
        F.when(F.col("template_path").isNotNull(), "a template of a path isn't read")
        .when(~F.coalesce("_type", F.lit("prompt")).isin("prompt", "few_shot"), "unknown type")
        .when(F.coalesce("template_format", F.lit("f-string")) != "f-string", "only f-string templates are read")
        .when(F.col("whole").isNull(), "no template")
        .when(F.col("fields").isNull(), "a stray brace or a name that isn't plain")
        .when(F.col("input_variables").isNotNull() & (F.array_sort("input_variables") != F.array_sort("fields")), "other fields than it says")
    )
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", name.alias("name"), F.when(error.isNull(), F.col("whole")).alias("template"), "fields", error.alias("error"))


def _fields(text: str | None) -> list[str] | None:
    try:
        return None if text is None else template_fields(text)
    except ValueError:
        return None
