"""A small part of the jinja2 language, compiled to column expressions: variables, filters, conditions, loops.

Nothing of a template runs: names are columns, fields of structs and variables of loops, and what isn't one of them is an error
when the template is compiled, as are calls, and names that begin with an underscore. The types of the columns are known then,
so that a value's truth is its type's: not null and not empty, zero or false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = tuple[Column, T.DataType]
Scope = dict[str, Value]
_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>|().,~+*/%\[\]-]))""")
_LONG, _DOUBLE, _STRING, _BOOLEAN = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def truth(v: Value) -> Column:
    c, t = v
    full = F.size(c) > 0 if isinstance(t, T.ArrayType | T.MapType) else c != "" if isinstance(t, T.StringType) else c != 0 if _number(t) else c if isinstance(t, T.BooleanType) else c.isNotNull()
    return F.coalesce(full, F.lit(False))


def shown(v: Value) -> Column:
    """A value as text; null is empty."""
    c, t = v
    if isinstance(t, T.BooleanType):
        c = F.when(c, "True").when(~c, "False")
    elif isinstance(t, T.ArrayType | T.MapType | T.StructType):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _text(f: Callable[..., Column]) -> Callable[..., Value]:
    return lambda v, *a: (f(shown(v), *(x[0] for x in a)), _STRING)


def _default(v: Value, other: Value) -> Value:
    same = type(v[1]) is type(other[1]) or (_number(v[1]) and _number(other[1]))
    return (F.coalesce(v[0], other[0]), v[1]) if same else (F.coalesce(v[0].cast("string"), other[0].cast("string")), _STRING)


def _at(place: int) -> Callable[[Value], Value]:
    def pick(v: Value) -> Value:
        if not isinstance(v[1], T.ArrayType):
            raise ValueError("first and last are of lists")
        return F.try_element_at(v[0], F.lit(place)), v[1].elementType

    return pick


def _join(v: Value, by: Value | None = None) -> Value:
    if not isinstance(v[1], T.ArrayType):
        raise ValueError("join is of lists")
    kind = v[1].elementType
    return F.call_function("array_join", F.transform(v[0], lambda x: shown((x, kind))), by[0] if by else F.lit("")), _STRING


FILTERS: dict[str, Callable[..., Value]] = {
    "upper": _text(F.upper), "lower": _text(F.lower), "trim": _text(F.trim), "capitalize": _text(lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))),
    "replace": _text(lambda c, a, b: F.replace(c, a, b)), "string": _text(lambda c: c),
    "length": lambda v: (F.coalesce(F.size(v[0]) if isinstance(v[1], T.ArrayType | T.MapType) else F.length(v[0]), F.lit(0)).cast("long"), _LONG),
    "default": _default, "join": _join, "first": _at(1), "last": _at(-1), "abs": lambda v: (F.abs(v[0]), v[1]),
    "round": lambda v, *n: (F.round(v[0].cast("double"), n[0][0] if n else 0), _DOUBLE), "int": lambda v: (F.coalesce(v[0].try_cast("double").cast("long"), F.lit(0)), _LONG),
}


class _Expression:
    """One expression, read from left to right."""

    def __init__(self, text: str, scope: Scope):
        self.text, self.scope, self.at, self.tokens = text, scope, 0, []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:].strip()!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()

    def _peek(self, *words: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in words:
            return self.tokens[self.at][1]
        return None

    def _take(self, *words: str) -> str | None:
        found = self._peek(*words)
        self.at += found is not None
        return found

    def _need(self, word: str) -> None:
        if not self._take(word):
            raise ValueError(f"{word!r} is missing in {self.text!r}")

    def whole(self) -> Value:
        v = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"can't read {self.tokens[self.at][1]!r} in {self.text!r}")
        return v

    def either(self) -> Value:
        v = self.both()
        while self._take("or"):
            v = truth(v) | truth(self.both()), _BOOLEAN
        return v

    def both(self) -> Value:
        v = self.negated()
        while self._take("and"):
            v = truth(v) & truth(self.negated()), _BOOLEAN
        return v

    def negated(self) -> Value:
        if self._take("not"):
            return ~truth(self.negated()), _BOOLEAN
        return self.compared()

    def compared(self) -> Value:
        v = self.joined()
        if op := self._take("==", "!=", "<", ">", "<=", ">="):
            a, b = v[0], self.joined()[0]
            made = {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
            return F.coalesce(made, F.lit(False)), _BOOLEAN
        if self._take("in"):
            other = self.joined()
            inside = F.array_contains(other[0], v[0]) if isinstance(other[1], T.ArrayType) else F.contains(other[0], shown(v))
            return F.coalesce(inside, F.lit(False)), _BOOLEAN
        return v

    def joined(self) -> Value:
        v = self.product()
        while op := self._take("+", "-", "~"):
            w = self.product()
            if op == "~" or (op == "+" and isinstance(v[1], T.StringType)):
                v = F.concat(shown(v), shown(w)), _STRING
            else:
                v = (v[0] + w[0] if op == "+" else v[0] - w[0]), (_DOUBLE if isinstance(v[1], T.DoubleType) or isinstance(w[1], T.DoubleType) else v[1])
        return v

    def product(self) -> Value:
        v = self.filtered()
        while op := self._take("*", "/", "%"):
            w = self.filtered()
            v = (v[0] * w[0] if op == "*" else v[0] / w[0] if op == "/" else v[0] % w[0]), (_DOUBLE if op == "/" or isinstance(v[1], T.DoubleType) else v[1])
        return v

    def filtered(self) -> Value:
        v = self.single()
        while self._take("|"):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            if name not in FILTERS:
                raise ValueError(f"no filter {name!r}")
            self.at += 1
            given = []
            if self._take("("):
                while not self._take(")"):
                    given.append(self.either())
                    if not self._take(",") and not self._peek(")"):
                        raise ValueError(f"')' is missing in {self.text!r}")
            v = FILTERS[name](v, *given)
        return v

    def single(self) -> Value:
        if self._take("("):
            v = self.either()
            self._need(")")
            return v
        if self._take("-"):
            c, t = self.single()
            return -c, t
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.text!r} breaks off")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return (F.lit(float(word)), _DOUBLE) if "." in word else (F.lit(int(word)), _LONG)
        if kind == 2:
            return F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])), _STRING
        if kind == 4:
            raise ValueError(f"can't read {word!r} in {self.text!r}")
        if word.lower() in ("true", "false"):
            return F.lit(word.lower() == "true"), _BOOLEAN
        if word.startswith("_") or word not in self.scope:
            raise ValueError(f"no name {word!r}; there are {sorted(self.scope)}")
        v = self.scope[word]
        while self._take("."):
            field = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            if field.startswith("_") or not isinstance(v[1], T.StructType) or field not in v[1].fieldNames():
                raise ValueError(f"no field {field!r} in {self.text!r}")
            v = v[0][field], v[1][field].dataType
        if self._peek("(", "["):
            raise ValueError(f"calls and places aren't possible: {self.text!r}")
        return v


def _parts(text: str) -> list[tuple[str, str]]:
    """(kind, body): text, expressions and statements; a dash takes the white space on its side away."""
    out, at, strip = [], 0, False
    for m in _PART.finditer(text):
        lead = text[at : m.start()]
        lead = lead.lstrip() if strip else lead
        if m[1] or m[4] or m[7]:
            lead = lead.rstrip()
        out.append(("text", lead))
        if m[2] is not None:
            out.append(("show", m[2].strip()))
        elif m[5] is not None:
            out.append(("do", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
    rest = text[at:]
    if re.search(r"\{\{|\{%|\{#", rest):
        raise ValueError("a tag isn't closed")
    return [*out, ("text", rest.lstrip() if strip else rest)]


class _Template:
    def __init__(self, text: str):
        self.parts, self.at = _parts(text), 0

    def until(self, scope: Scope, *ends: str) -> tuple[Column, str]:
        """The text up to one of some statements, and that statement."""
        out = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(F.lit(body))
            elif kind == "show":
                out.append(shown(_Expression(body, scope).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return F.concat(*out, F.lit("")), body
                if word == "if":
                    out.append(self.condition(rest, scope))
                elif word == "for":
                    out.append(self.loop(rest, scope))
                else:
                    raise ValueError(f"no statement {body!r} here")
        if ends:
            raise ValueError(f"{ends[-1]!r} is missing")
        return F.concat(*out, F.lit("")), ""

    def condition(self, test: str, scope: Scope) -> Column:
        chosen = truth(_Expression(test, scope).whole())
        body, end = self.until(scope, "elif", "else", "endif")
        if end == "endif":
            other = F.lit("")
        elif end == "else":
            other, _ = self.until(scope, "endif")
        else:
            other = self.condition(end.partition(" ")[2], scope)
        return F.when(chosen, body).otherwise(other)

    def loop(self, head: str, scope: Scope) -> Column:
        m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", head, re.S)
        if not m:
            raise ValueError(f"can't read the loop {head!r}")
        over, kind = _Expression(m[2], scope).whole()
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{m[2]!r} isn't a list")
        about = T.StructType([T.StructField(n, _LONG if n.startswith("index") or n == "length" else _BOOLEAN) for n in ("index", "index0", "length", "first", "last")])
        start, ends = self.at, []

        def body(x: Column, i: Column) -> Column:
            self.at = start
            n = F.size(over)
            of = F.struct((i + 1).cast("long").alias("index"), i.cast("long").alias("index0"), n.cast("long").alias("length"), (i == 0).alias("first"), (i == n - 1).alias("last"))
            made, end = self.until({**scope, m[1]: (x, kind.elementType), "loop": (of, about)}, "else", "endfor")
            ends.append(end)
            return made

        text = F.array_join(F.transform(over, body), "")
        if ends[-1] == "else":
            other, _ = self.until(scope, "endfor")
            return F.when(F.coalesce(F.size(over) > 0, F.lit(False)), text).otherwise(other)
        return F.coalesce(text, F.lit(""))


def rendered(df: DataFrame, text: str, name: str = "prompt") -> DataFrame:
    """df with a template's text as a column; the template's names are df's columns."""
    scope = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    return df.withColumn(name, _Template(text).until(scope)[0])
