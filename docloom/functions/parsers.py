"""Parsers of what models answer: tool calls, structured values, agents' texts, schemas; and repair loops around them.

Columns where the engine has what it takes, pandas UDFs else. Where an answer can't be parsed, the value is null and the
reason is in an error field, unless a parser says otherwise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import ColumnOrName, col
from docloom.functions.text import fenced

CALLS = "array<struct<id:string,name:string,args:string>>"


def tool_calls(message: ColumnOrName) -> Column:
    """The calls in a message's JSON ({"tool_calls": [{"id", "name", "args"} or {"id", "function": {"name", "arguments"}}]}), args as JSON text."""
    shape = "struct<tool_calls:array<struct<id:string,name:string,args:string,`function`:struct<name:string,arguments:string>>>>"
    found = F.from_json(col(message), shape)["tool_calls"]
    one = lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["name"], c["function"]["name"]).alias("name"), F.coalesce(c["args"], c["function"]["arguments"]).alias("args"))
    return F.coalesce(F.transform(found, one).cast(CALLS), F.array().cast(CALLS))


def calls_named(calls: ColumnOrName, name: str) -> Column:
    return F.filter(col(calls), lambda c: c["name"] == name)


def first_args(calls: ColumnOrName, name: str, schema: str) -> Column:
    """The arguments of the first call of a tool, as a struct; null if there is none or they don't fit."""
    return F.from_json(F.get(calls_named(calls, name), F.lit(0))["args"], schema)


def structured(answer: ColumnOrName, fields: dict[str, str]) -> Column:
    """A struct of named fields from JSON in an answer (fenced or bare); null unless all fields are there."""
    body = F.coalesce(F.nullif(fenced(col(answer)), F.lit("")), col(answer))
    value = F.from_json(body, ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    whole = F.lit(True)
    for n in fields:
        whole = whole & value[n].isNotNull()
    return F.when(whole, value)


def yaml_value(text: str) -> object:
    """Plain YAML: nested maps and lists by indentation, and scalars. What goes beyond is an error."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("#", "---"))]

    def scalar(s: str) -> object:
        s = re.sub(r"\s+#.*$", "", s).strip()
        if s[:1] in "\"[{":
            return json.loads(s)
        if s[:1] == "'":
            return s[1:-1].replace("''", "'")
        if s[:1] in ("&", "*", "|", ">", "!"):
            raise ValueError(f"not plain YAML: {s!r}")
        known = {"": None, "~": None, "null": None, "true": True, "false": False}
        if s.lower() in known:
            return known[s.lower()]
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    def block(at: int, indent: int) -> tuple[object, int]:
        out: object = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if isinstance(out, list):
                if not body.startswith("-"):
                    raise ValueError("a list and a map share their place")
                inner = body[1:].lstrip()
                if re.match(r"[\w\"' .-]+:(\s|$)", inner):  # a map that begins beside the mark
                    lines[at] = (indent + len(body) - len(inner), inner)
                    value, at = block(at, lines[at][0])
                elif inner:
                    value, at = scalar(inner), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
                continue
            name, colon, rest = body.partition(":")
            if not colon:
                raise ValueError(f"no key: {body!r}")
            at += 1
            if rest.strip():
                value = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                value, at = block(at, lines[at][0])
            else:
                value = None
            out[name.strip().strip("\"'")] = value
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError("indentation")
        return out, at

    if not lines:
        return None
    if len(lines) == 1 and not re.match(r"(-\s|[^\"'\[{].*:(\s|$))", lines[0][1]):
        return scalar(lines[0][1])
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError("indentation")
    return value


def yaml_to_json(answer: ColumnOrName) -> Column:
    """Plain YAML in an answer (fenced or bare) as JSON text; null where it can't be read."""
    fence = re.compile(r"```(?:ya?ml)?[ \t]*\n(.*?)(?:```|\Z)", re.S)

    @F.pandas_udf("string")
    def parse(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(yaml_value(m[1] if (m := fence.search(t)) else t))
            except (ValueError, IndexError):
                return None

        return pd.Series([one(t) for t in x], dtype=object)

    return parse(col(answer))


def repaired(answer: Column, parse: Callable[[Column], Column], fix: Callable[[Column], Column], rounds: int = 1) -> Column:
    """The parsed answer; where it is null, a model's repair of the answer is parsed, ``rounds`` times at most."""
    value = parse(answer)
    for _ in range(rounds):
        answer = fix(answer)
        value = F.coalesce(value, parse(answer))
    return value


def resolved(schema: object, root: object | None = None, seen: tuple[str, ...] = ()) -> object:
    """A JSON schema without references: each local $ref is replaced by what it names; one that leads back to itself stays."""
    root = schema if root is None else root
    if isinstance(schema, list):
        return [resolved(x, root, seen) for x in schema]
    if not isinstance(schema, dict):
        return schema
    ref = schema.get("$ref")
    if isinstance(ref, str) and ref not in seen:
        if not ref.startswith("#"):
            raise ValueError(f"not a local reference: {ref!r}")
        to = root
        for part in filter(None, ref[1:].split("/")):
            part = part.replace("~1", "/").replace("~0", "~")
            to = to[int(part)] if isinstance(to, list) else to[part]
        beside = {k: resolved(v, root, seen) for k, v in schema.items() if k != "$ref"}
        inner = resolved(to, root, (*seen, ref))
        return inner | beside if isinstance(inner, dict) else inner
    return {k: resolved(v, root, seen) for k, v in schema.items() if not (k in ("$defs", "definitions") and schema is root)}


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def fits(value: object, schema: object) -> bool:
    """Whether a value is valid by a JSON schema without references: types, enum, const, bounds, lengths, pattern, properties, items, combinations."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type", ())
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
        return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))

    if kinds and not any(map(is_a, kinds)):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, int | float) and not isinstance(value, bool):
        bounds = (("minimum", lambda b: value >= b), ("maximum", lambda b: value <= b), ("exclusiveMinimum", lambda b: value > b), ("exclusiveMaximum", lambda b: value < b), ("multipleOf", lambda b: float(value / b).is_integer()))
        if not all(ok(schema[n]) for n, ok in bounds if n in schema):
            return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) or not all(fits(x, schema.get("items", True)) for x in value):
            return False
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(n not in value for n in schema.get("required", ())) or not all(fits(value[n], s) for n, s in known.items() if n in value):
            return False
        if not all(fits(v, schema.get("additionalProperties", True)) for n, v in value.items() if n not in known):
            return False
    parts = {"allOf": all, "anyOf": any, "oneOf": lambda found: sum(found) == 1}
    return all(how([fits(value, s) for s in schema[n]]) for n, how in parts.items() if n in schema) and not ("not" in schema and fits(value, schema["not"]))


def schema_valid(text: ColumnOrName, schema: dict) -> Column:
    """1 where a text is JSON that is valid by the schema, else 0."""
    whole = resolved(schema)

    @F.pandas_udf("int")
    def valid(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> int:
            try:
                return int(fits(json.loads(t), whole))
            except (ValueError, TypeError):
                return 0

        return pd.Series([one(t) for t in x])

    return valid(col(text))


def react_step(answer: ColumnOrName) -> Column:
    """A step of the form "Thought ... Action: tool, Action Input: ..." or "Final Answer: ...": struct of action, input, final and error.

    An answer with both an action and a final answer, or neither, is an error. Quotation marks around the whole input go.
    """
    a = F.coalesce(col(answer), F.lit(""))
    pattern = r"(?s)Action\s*\d*\s*:[ \t]*([^\n]*?)[ \t]*\n+\s*Action\s*\d*\s*Input\s*\d*\s*:[ \t]*(.*)$"
    acts, ends = a.rlike(pattern), F.contains(a, F.lit("Final Answer:"))
    given = F.regexp_replace(F.trim(F.regexp_extract(a, pattern, 2)), '^"|"$', "")
    error = F.when(acts & ends, "both a final answer and an action").when(~acts & ~ends, "neither a final answer nor an action")
    good = error.isNull()
    final = F.trim(F.substring_index(a, "Final Answer:", -1))
    return F.struct(F.when(good & acts, F.trim(F.regexp_extract(a, pattern, 1))).alias("action"), F.when(good & acts, given).alias("input"), F.when(good & ends, final).alias("final"), error.alias("error"))


def self_ask_step(answer: ColumnOrName, marks: tuple[str, ...] = ("Follow up:", "Followup:"), finish: str = "So the final answer is:") -> Column:
    """The follow-up question on an answer's last line, or its final answer: struct of question, final and error."""
    last = F.element_at(F.split(F.coalesce(col(answer), F.lit("")), "\n"), -1)
    asks = F.lit(False)
    for m in marks:
        asks = asks | F.contains(last, F.lit(m))
    ends = F.contains(last, F.lit(finish))
    question = F.trim(F.regexp_extract(last, r":\s*([^:]*)$", 1))
    return F.struct(F.when(asks, question).alias("question"), F.when(~asks & ends, F.trim(F.substring_index(last, finish, -1))).alias("final"), F.when(~asks & ~ends, "neither a follow-up nor a final answer").alias("error"))


def tagged_step(answer: ColumnOrName) -> Column:
    """A step in tags: <tool>..</tool><tool_input>..</tool_input>, or <final_answer>..</final_answer>: struct of action, input and final."""
    a = F.coalesce(col(answer), F.lit(""))
    inside = lambda tag: F.nullif(F.regexp_extract(a, rf"(?s)<{tag}>(.*?)(?:</{tag}>|$)", 1), F.lit(""))
    return F.struct(inside("tool").alias("action"), inside("tool_input").alias("input"), inside("final_answer").alias("final"))


#: Model names by what they begin with, and their provider.
PROVIDERS = (
    ("gpt-", "openai"), ("o1", "openai"), ("o3", "openai"), ("chatgpt", "openai"), ("text-davinci", "openai"), ("claude", "anthropic"), ("command", "cohere"), ("accounts/fireworks", "fireworks"), ("gemini", "google_vertexai"),
    ("amazon.", "bedrock"), ("anthropic.", "bedrock"), ("meta.", "bedrock"), ("mistral", "mistralai"), ("mixtral", "mistralai"), ("deepseek", "deepseek"), ("grok", "xai"), ("sonar", "perplexity"), ("solar", "upstage"),
)


def provider_model(name: ColumnOrName) -> Column:
    """struct of provider and model of "provider:model"; without a provider it follows from the model's name, or is null.

    What stands before a colon is a provider if it is one of those known, or if the whole name isn't that of a known model
    (whose names have colons, too).
    """
    n = col(name)
    before = F.replace(F.lower(F.trim(F.substring_index(n, ":", 1))), F.lit("-"), F.lit("_"))
    guess = F.lit(None).cast("string")
    for start, provider in reversed(PROVIDERS):
        guess = F.when(F.lower(n).startswith(start), provider).otherwise(guess)
    split = F.contains(n, F.lit(":")) & (before.isin(sorted({p for _, p in PROVIDERS})) | guess.isNull())
    return F.struct(F.when(split, before).otherwise(guess).alias("provider"), F.when(split, F.regexp_replace(n, "^[^:]*:", "")).otherwise(n).alias("model"))


DIGITS = "零一二三四五六七八九"


def han_number(value: ColumnOrName) -> Column:
    """The number that Chinese numerals up to 99 write; digits are taken as they are; null for others."""
    v = F.trim(col(value))
    place = lambda c: F.call_function("locate", c, F.lit(DIGITS)) - 1
    tens, ones = F.substring_index(v, "十", 1), F.substring_index(v, "十", -1)
    at = lambda c, empty: F.when(c == "", empty).otherwise(place(c))
    written = F.when(v.rlike(f"^[{DIGITS}]$"), place(v)).when(v.rlike(f"^[{DIGITS[1:]}]?十[{DIGITS[1:]}]?$"), at(tens, 1) * 10 + at(ones, 0))
    return F.when(v.rlike("^[0-9]{1,9}$"), v.try_cast("int")).otherwise(written)


def han_numeral(value: ColumnOrName) -> Column:
    """Chinese numerals of a number from 0 to 99; null beyond."""
    n = col(value)
    digit = lambda d: F.substring(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    two = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise(""))
    return F.when(n.between(0, 9), digit(n)).when(n.between(10, 99), two)


def reason_of(text: ColumnOrName) -> Column:
    """The reason that a reviewer's note gives after a mark such as "reason:" or 原因：; empty without one."""
    return F.trim(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?:原因|理由|(?i:reason))\s*[:：]\s*([^\n]*)", 1))


def rubric(*indicators: Column) -> Column:
    """The mean of yes-or-no indicators; a null one counts as no."""
    total = F.lit(0)
    for i in indicators:
        total = total + F.when(F.coalesce(i, F.lit(False)), 1).otherwise(0)
    return total / F.lit(float(len(indicators)))
