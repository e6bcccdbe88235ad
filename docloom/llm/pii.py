"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust their score.

Column expressions only. A span's place comes from two built-in calls: ``regexp_extract_all`` gives the matches and
``split`` by the same pattern the text between them, whose lengths are summed in blocks. Patterns are possessive and can
start in one place of a run only, and context is read from blocks of the text, so neither a long run of digits or letters
nor a text with a hundred thousand matches costs more than about its length.

Kinds: email, ip, card and phone are base kinds (a valid match is always reported); iban must pass mod 97; secret, a
long hexadecimal string, is reported only if words such as "token" stand near it. score: the kind's own score, raised by
words of the kind nearby and lowered by words that speak against it, within 0 and 1.

Defined cases: a null text is an empty one; overlapping spans of different kinds are all reported, and redacted as
one; places are code points, ends exclusive. Each row is handled by itself: no shuffle, other columns are untouched; one with the
name of the new column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrays import in_blocks, piece, running

BEFORE, AFTER = 40, 25
REPORT = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str | None  # a literal without which no match exists
    score: float
    near: str  # words that raise the score
    against: str | None = None  # words that lower it
    base: bool = False


KINDS = (
    # a match can start where a run of local-part characters does, or where the last match ended
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write", None, True),
    Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", ".", 0.6, r"\bip\b|address|host|server|login", "version|release|section", True),
    # a whole run of digits with single separators, if it has 12 to 19 of them
    Kind("card", r"[0-9](?<![0-9]{2})(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])", None, 0.7, "card|credit|visa|payment|konto|tarjeta|carte", "order|tracking|serial", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax", None, True),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None, 0.9, "iban|bank|account|konto"),
    Kind("secret", r"[0-9a-fA-F](?<![A-Za-z0-9].)[0-9a-fA-F]{31,127}+(?![A-Za-z0-9])", None, 0.3, "token|secret|password|passwd|api.?key|credential"),
)
RANK = {k.name: i for i, k in enumerate(KINDS)}


def mod97(iban: Column) -> Column:
    """Whether the check digits of an IBAN without spaces are right (ISO 13616)."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _spans(k: Kind, found: Column, starts: Column, blocks: Column) -> Column:
    """The confirmed spans among the matches found."""
    placed = F.zip_with(F.slice(starts, 1, F.size(found)), found, lambda s, m: F.struct(s.alias("start"), m.alias("value")))

    def span(m: Column) -> Column:
        end = m.start + F.length(m.value)
        around = F.lower(F.concat_ws(" ", piece(blocks, F.greatest(m.start - BEFORE, F.lit(0)), F.least(m.start, F.lit(BEFORE))), piece(blocks, end, F.lit(AFTER))))
        score = F.lit(k.score) + F.when(around.rlike(k.near), 0.3).otherwise(0.0)
        if k.against:
            score = score - F.when(around.rlike(k.against), 0.3).otherwise(0.0)
        return F.struct(m.start.alias("start"), F.lit(RANK[k.name]).alias("rank"), F.lit(k.name).alias("kind"), end.alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    spans = F.transform(F.filter(placed, lambda m: _valid(k.name, m.value)), span)
    if not k.base:
        spans = F.filter(spans, lambda s: s.score >= REPORT)
    return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(spans.cast(_SPANS))


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with a column of spans (start, rank, kind, end, score), by start, then kind as listed."""
    names = [c for c in df.columns if c != out]
    of = lambda what, k=None: f"__pii_{what}" + (f"_{k.name}" if k else "")
    none = F.array().cast("array<string>")

    def propose(k: Kind) -> Column:
        found = F.regexp_extract_all(of("text"), F.lit(k.pattern), F.lit(0))
        return F.when(F.contains(F.col(of("text")), F.lit(k.needs)), found).otherwise(none) if k.needs else found

    df = df.withColumn(of("text"), F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({of("found", k): propose(k) for k in KINDS})
    some = lambda k: F.size(of("found", k)) > 0
    df = df.withColumns({
        of("blocks"): F.when(reduce(lambda a, b: a | b, map(some, KINDS)), in_blocks(F.col(of("text")))).otherwise(none),
        **{of("gaps", k): F.when(some(k), F.transform(F.split(of("text"), F.lit(k.pattern), -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>")) for k in KINDS},
    })
    steps = {of("before", k): F.zip_with(of("gaps", k), of("found", k), lambda g, m: g + F.coalesce(F.length(m), F.lit(0))) for k in KINDS}
    df = running(df, steps, lambda a, b: a + b)
    df = df.withColumns({of("starts", k): F.zip_with(of("gaps", k), of("before", k), lambda g, s: g + s) for k in KINDS})
    found = [_spans(k, F.col(of("found", k)), F.col(of("starts", k)), F.col(of("blocks"))) for k in KINDS]
    return df.select(*names, F.array_sort(F.concat(*found)).alias(out))


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.rank < sum(k.base for k in KINDS))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its spans redacted in place, overlapping ones as one, by the kind of the first in brackets; a null text stays null."""
    names = df.columns
    df = with_spans(df, text, "__spans")
    df = running(df, {"__reach": F.transform("__spans", lambda s: s.end)}, lambda a, b: F.greatest(a, b))
    df = df.withColumn("__blocks", F.when(F.size("__spans") > 0, in_blocks(F.col(text))).otherwise(F.array().cast("array<string>")))
    # a span that begins where all before it have ended opens a group
    opens = F.filter(F.zip_with("__spans", F.slice("__reach", 1, F.size("__spans")), lambda s, r: F.struct(r.alias("after"), s.start.alias("start"), s.kind.alias("kind"))), lambda x: x.start >= x.after)
    blocks, all_ = F.col("__blocks"), F.element_at("__reach", -1)
    parts = F.transform(opens, lambda x: F.concat(piece(blocks, x.after, x.start - x.after), F.lit("["), F.upper(x.kind), F.lit("]")))
    done = F.concat(F.array_join(parts, ""), piece(blocks, all_, F.length(text) - all_))
    return df.withColumn("__done", F.when(F.size("__spans") == 0, F.col(text)).otherwise(done)).select(*((F.col("__done") if c == text else F.col(c)).alias(c) for c in names))
