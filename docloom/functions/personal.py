"""Detection and redaction of personal data by kind: email, credit_card, ip, mac_address, url, or a pattern of one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import ColumnOrName, col

#: What the kinds match and how matches are masked (in ``masked``) decides the results and has to agree.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "credit_card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "ip": rf"\b{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "url": r"\bhttps?://[^\s<>\"{}|\\^`\[\]]+|\b(?:www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>]*)?|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}/[^\s<>]*)",
}
STRATEGIES = ("redact", "mask", "hash", "block")


def _valid(kind: str, match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", "")) if kind == "credit_card" else F.lit(True)


def matches(text: ColumnOrName, kind: str, pattern: str | None = None) -> Column:
    """The confirmed matches of a kind, in order."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern or PATTERNS[kind]), F.lit(0))
    return F.filter(found, lambda m: _valid(kind, m)) if kind == "credit_card" else found


def masked(kind: str, match: Column) -> Column:
    """A match with all but its telling part starred out. The marks are fixed values."""
    if kind == "email":
        return F.concat(F.substring_index(match, "@", 1), F.lit("@****."), F.substring_index(match, ".", -1))
    if kind == "credit_card":
        mark = F.when(match.contains("-"), "-").when(match.contains(" "), " ").otherwise("")
        return F.concat(F.lit("****"), mark, F.lit("****"), mark, F.lit("****"), mark, F.right(F.regexp_replace(match, "[^0-9]", ""), F.lit(4)))
    if kind == "ip":
        return F.concat(F.lit("*.*.*."), F.substring_index(match, ".", -1))
    if kind == "mac_address":
        mark = F.when(match.contains(":"), ":").otherwise("-")
        return F.concat(*[x for _ in range(5) for x in (F.lit("**"), mark)], F.right(match, F.lit(2)))
    return F.lit("[MASKED_URL]") if kind == "url" else F.lit("****")


def apply(text: ColumnOrName, kind: str, strategy: str = "redact", pattern: str | None = None) -> Column:
    """The text with each confirmed match replaced by the strategy; block: an error at the first match."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} isn't one of {STRATEGIES}")
    name, regex = kind.upper(), pattern or PATTERNS[kind]
    t = F.coalesce(col(text), F.lit(""))
    if strategy == "block":
        wrong = F.raise_error(F.concat(F.lit(f"{kind} found in text: "), F.element_at(matches(text, kind, pattern), 1)))
        return F.when(F.size(matches(text, kind, pattern)) > 0, wrong.cast("string")).otherwise(col(text))
    if strategy == "redact" and kind != "credit_card":
        return F.when(col(text).isNotNull(), F.regexp_replace(t, F.lit(regex), F.lit(f"[REDACTED_{name}]")))
    change = {
        "redact": lambda m: F.lit(f"[REDACTED_{name}]"),
        "mask": lambda m: masked(kind, m),
        "hash": lambda m: F.concat(F.lit(f"<{kind}_hash:"), F.substring(F.sha2(m, 256), 1, 8), F.lit(">")),
    }[strategy]
    found, rest = F.regexp_extract_all(t, F.lit(regex), F.lit(0)), F.split(t, F.lit(regex), -1)
    new = F.transform(found, lambda m: F.when(_valid(kind, m), change(m)).otherwise(m))
    joined = F.array_join(F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(col(text).isNotNull(), joined)


def rules(df: DataFrame, text: str, kinds: dict[str, str], where: Column | None = None) -> DataFrame:
    """df with several kinds' strategies applied to a column in turn, to the rows chosen only."""
    for kind, strategy in kinds.items():
        new = apply(text, kind, strategy)
        df = df.withColumn(text, new if where is None else F.when(where, new).otherwise(F.col(text)))
    return df
