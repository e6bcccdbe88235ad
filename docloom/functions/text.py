"""Text expressions: normalising, parsing model output, templates, links, lists, simple scores."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import ColumnOrName, col, regex_quote


def compact(text: ColumnOrName) -> Column:
    """White space to single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def for_match(text: ColumnOrName) -> Column:
    """Without Markdown marks and white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[*_`#>\-]+", ""), r"\s+", ""))


def preview(text: ColumnOrName, limit: int = 80) -> Column:
    """At most ``limit`` characters of the compacted text, with dots where some are left out."""
    c = compact(text)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("...")))


def contains_any(text: ColumnOrName, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(col(text), F.lit(m))
    return found


def han_terms(text: ColumnOrName, least: int = 2, most: int = 16, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of two to ten Han characters in order, without stop words."""
    found = F.regexp_extract_all(col(text), F.lit(r"[一-鿿]{%d,10}" % least), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(*stop)) if stop else found
    return F.slice(F.array_distinct(kept), 1, most)


def token_overlap(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Shared distinct words over the larger number of distinct words; 0 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(compact(c)), " "), lambda w: w != ""))
    most = F.greatest(F.size(words(left)), F.size(words(right)))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(words(left), words(right))) / most)


def count_of(text: ColumnOrName, term: str) -> Column:
    """Occurrences of a term that don't overlap."""
    return ((F.length(col(text)) - F.length(F.replace(col(text), F.lit(term), F.lit("")))) / len(term)).cast("long")


def exact_match(prediction: ColumnOrName, reference: ColumnOrName, *, ignore_case: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    """1 where both are the same after the things to ignore are gone, else 0."""

    def clean(c: Column) -> Column:
        c = F.lower(c) if ignore_case else c
        c = F.translate(c, string.punctuation, "") if ignore_punctuation else c
        return F.translate(c, string.digits, "") if ignore_numbers else c

    return (clean(col(prediction)) == clean(col(reference))).cast("int")


def regex_match(prediction: ColumnOrName, pattern: str, flags: str = "") -> Column:
    """1 where the pattern matches at the start."""
    return F.coalesce(col(prediction), F.lit("")).rlike(f"{f'(?{flags})' if flags else ''}\\A(?:{pattern})").cast("int")


def normalized_levenshtein(a: ColumnOrName, b: ColumnOrName) -> Column:
    most = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(col(a), col(b)) / most)


def comma_list(text: ColumnOrName) -> Column:
    return F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def numbered_list(text: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"\d+\.\s([^\n]+)"), F.lit(1))


def bullet_list(text: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"(?m)^\s*[-*]\s([^\n]+)$"), F.lit(1))


def line_list(text: ColumnOrName) -> Column:
    return F.filter(F.split(col(text), "\n"), lambda x: F.trim(x) != "")


def has_word(text: ColumnOrName, word: str) -> Column:
    """Whether a word stands alone in a text, in any case. Letters, digits and _ of any script make up words, whatever the regex engine's own idea of a boundary."""
    return col(text).rlike(rf"(?i)(^|[^\pL\pN_]){regex_quote(word)}([^\pL\pN_]|$)")


def yes_no(text: ColumnOrName, true: str = "YES", false: str = "NO") -> Column:
    """True or false by which word occurs; both, or neither, is an error."""
    has = lambda w: has_word(text, w)
    wrong = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.coalesce(col(text), F.lit("null")))).cast("boolean")
    return F.when(has(true) & has(false), wrong("ambiguous answer")).when(has(true), True).when(has(false), False).otherwise(wrong("no answer"))


def enum_value(text: ColumnOrName, values: list[str]) -> Column:
    t = F.trim(col(text))
    return F.when(t.isin(values), t).otherwise(F.raise_error(F.concat(F.lit("not one of the values: "), F.coalesce(t, F.lit("null")))))


def regex_fields(text: ColumnOrName, pattern: str, keys: list[str]) -> Column:
    """A struct of a pattern's groups; empty strings where it doesn't match."""
    return F.struct(*(F.regexp_extract(col(text), pattern, i + 1).alias(k) for i, k in enumerate(keys)))


def grade(text: ColumnOrName) -> Column:
    """1 for CORRECT, 0 for INCORRECT, null where neither is found: the word after GRADE:, else the last word."""
    word = r"\b(CORRECT|INCORRECT)\b"
    up = F.upper(col(text))
    found = F.coalesce(F.nullif(F.regexp_extract(up, r"GRADE:\s*" + word, 1), F.lit("")), F.nullif(F.regexp_extract(up, r"(?s).*" + word, 1), F.lit("")))
    return F.when(found == "CORRECT", 1).when(found == "INCORRECT", 0)


def verdict(text: ColumnOrName) -> Column:
    """1 for a last line of Y, 0 for N, else null."""
    last = F.upper(F.trim(F.element_at(F.split(F.trim(col(text)), "\n"), -1)))
    return F.when(last == "Y", 1).when(last == "N", 0)


def pairwise_choice(text: ColumnOrName) -> Column:
    """A, B or C of the last [[A]], [[B]] or [[C]]."""
    return F.nullif(F.regexp_extract(col(text), r"(?s).*\[\[([ABC])\]\]", 1), F.lit(""))


def bracket_score(text: ColumnOrName, scale: float = 1.0) -> Column:
    """n of [[n]] over a scale."""
    return F.nullif(F.regexp_extract(col(text), r"\[\[(10|[1-9])\]\]", 1), F.lit("")).cast("double") / scale


def snake_case(name: ColumnOrName) -> Column:
    return F.lower(F.regexp_replace(col(name), r"(?<!^)([A-Z])", "_$1"))


def without_nul(text: ColumnOrName, by: str = "") -> Column:
    return F.replace(col(text), F.lit("\0"), F.lit(by))


def without_thoughts(text: ColumnOrName) -> Column:
    """Without <think> sections; an unclosed one reaches to the end."""
    return F.trim(F.regexp_replace(col(text), r"(?s)<think>.*?(?:</think>|\z)", ""))


def fenced(text: ColumnOrName) -> Column:
    """What stands in the first ``` fence, else the text."""
    inner = F.regexp_extract(col(text), r"(?s)```(?:[A-Za-z]+)?\s*(.*?)\s*```", 1)
    return F.when(col(text).contains("```"), F.trim(inner)).otherwise(F.trim(col(text)))


def json_valid(text: ColumnOrName) -> Column:
    """1 where the text (or its fence) is JSON, else 0."""
    return F.try_parse_json(fenced(text)).isNotNull().cast("int")


#: Links that are not pages
SKIP_PREFIXES = ("javascript:", "mailto:", "#")
SKIP_SUFFIXES = (".css", ".js", ".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".csv", ".bz2", ".zip", ".epub", ".webp", ".pdf", ".docx", ".xlsx", ".pptx", ".pptm")


def links(page: ColumnOrName) -> Column:
    """Distinct href targets of a page in order, without scripts, mail addresses, anchors and assets."""
    found = F.regexp_extract_all(col(page), F.lit(r"href=[\"']([^\"'#]+)"), F.lit(1))

    def good(x: Column) -> Column:
        bad = F.lit(False)
        for p in SKIP_PREFIXES:
            bad = bad | x.startswith(p)
        for s in SKIP_SUFFIXES:
            bad = bad | F.regexp_replace(x, r"[?#].*$", "").endswith(s)
        return ~bad

    return F.array_distinct(F.filter(found, good))


_FIELD = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}|[{}]")


def template_fields(template: str) -> list[str]:
    """Names of a template's fields in order; a stray brace or anything but a plain name in braces is an error."""
    names = []
    for m in _FIELD.finditer(template):
        if m[1]:
            names.append(m[1])
        elif m[0] in "{}":
            raise ValueError(f"bad brace at {m.start()} in template {template!r}")
    return list(dict.fromkeys(names))


def template(text: str, **values: ColumnOrName) -> Column:
    """The template with {name} replaced by columns (same-named unless given); attribute access and indexing aren't possible."""
    template_fields(text)
    parts: list[Column] = []
    at = 0
    for m in _FIELD.finditer(text):
        parts.append(F.lit(text[at : m.start()] + (m[0][0] if m[0] in ("{{", "}}") else "")))
        if m[1]:
            parts.append(F.coalesce(col(values.get(m[1], m[1])).cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def arithmetic(expression: str) -> Column:
    """A column of an arithmetic expression; only numbers, names, + - * / % ( ) and . are let through."""
    if not re.fullmatch(r"[\w\s.+\-*/%()]+", expression):
        raise ValueError(f"not an arithmetic expression: {expression!r}")
    return F.expr(expression).cast("double")


def approximate_tokens(text: ColumnOrName, role: ColumnOrName | None = None, chars: float = 4.0, extra: float = 3.0) -> Column:
    """Tokens of one message: characters of text and role by ``chars``, rounded up, and ``extra``."""
    n = F.length(F.coalesce(col(text), F.lit(""))) + (F.length(col(role)) if role is not None else F.lit(0))
    return F.ceil(n / F.lit(chars)) + F.lit(extra)


def values_by_key(m: ColumnOrName) -> Column:
    """Values of a map in the order of its keys, joined by spaces."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col(m))), lambda e: e["value"].cast("string")), " ")


def backoff(attempt: ColumnOrName, factor: float = 2.0, initial: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before a retry, without jitter."""
    return F.least(F.pow(F.lit(factor), col(attempt)) * initial, F.lit(most))
