"""Scoring: distances of strings and JSON, confusion counts, roll-ups, descriptions, matching of labelled and found items."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folds import folded


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (b[j] for j in range(len(b)) if taken[j]), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    s = jaro(a, b)
    shared = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return s + shared * weight * (1 - s) if s > 0.7 else s


def edit_distance(a: str, b: str, swaps: bool = False, replace: int = 1) -> int:
    """Levenshtein distance; swaps: adjacent letters may change places (each letter edited once); replace 2: the indel distance."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (0 if x == y else replace))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [rows[-1], row]
    return rows[-1][-1]


def hamming(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))


_DISTANCES = {
    "damerau_levenshtein": lambda a, b: float(edit_distance(a, b, swaps=True)),
    "indel": lambda a, b: float(edit_distance(a, b, replace=2)),
    "hamming": lambda a, b: float(hamming(a, b)),
    "jaro": lambda a, b: 1 - jaro(a, b),
    "jaro_winkler": lambda a, b: 1 - jaro_winkler(a, b),
}


def string_distance(a: Column | str, b: Column | str, kind: str = "jaro_winkler", normalize: bool = False) -> Column:
    """The distance of two strings, normalised to 0..1 if asked. Levenshtein runs in the engine, others in a pandas UDF."""
    if kind == "levenshtein":
        d = F.levenshtein(a, b).cast("double")
        most = F.greatest(F.length(a), F.length(b))
        return F.when(most == 0, 0.0).otherwise(d / most) if normalize else d
    f = _DISTANCES[kind]

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            d = None if p is None or q is None else f(p, q)
            if normalize and d is not None and kind in ("damerau_levenshtein", "indel", "hamming"):
                most = len(p) + len(q) if kind == "indel" else max(len(p), len(q))
                d = d / most if most else 0.0
            out.append(d)
        return pd.Series(out, dtype="float64")

    return distance(a, b)


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """The larger of the matching-blocks ratio and the overlap of words."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str, q: str) -> float:
            if not p or not q:
                return 0.0
            u, v = set(p.lower().split()), set(q.lower().split())
            return max(difflib.SequenceMatcher(None, p, q).ratio(), len(u & v) / max(len(u), len(v), 1))

        return pd.Series([one(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return similarity(a, b)


def canonical(value: object) -> object:
    """JSON data with lists in the order of their items' text."""
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    return value


def json_equal(a: Column | str, b: Column | str) -> Column:
    """1 where both are JSON of the same value, whatever the order of lists; 0 otherwise."""

    @F.pandas_udf("int")
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q) -> int:
            try:
                return int(canonical(json.loads(p)) == canonical(json.loads(q)))
            except (ValueError, TypeError):
                return 0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return equal(a, b)


def json_distance(a: Column | str, b: Column | str) -> Column:
    """Normalised edit distance of the canonical JSON texts; 1 where one isn't JSON."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q) -> float:
            try:
                u, v = (json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) for t in (p, q))
            except (ValueError, TypeError):
                return 1.0
            return edit_distance(u, v, swaps=True) / max(len(u), len(v), 1)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return distance(a, b)


TAIL = 9  # what may have to go of a number, a literal or an escape that breaks off, and one more


def partial_json(text: str | None) -> object:
    """The value of JSON text that may break off: open strings and brackets are closed, an unfinished tail is cut off. None if there is none.

    One pass finds the places where the text can end: after an opening or closing bracket, and before a comma; besides, any of
    the last ``TAIL``. They are tried from the last on, and the first one nearly always does.
    """
    if not text:
        return None
    body = text.strip()
    ends: list[tuple[int, bool, tuple | None]] = []
    quoted = escaped = False
    open_: tuple | None = None  # (closing bracket, the ones around it)
    for i, c in enumerate(body):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_ = ("}" if c == "{" else "]", open_)
            ends.append((i + 1, False, open_))
        elif c in "}]":
            if open_ is None or open_[0] != c:
                return None
            open_ = open_[1]
            ends.append((i + 1, False, open_))
        elif c == "," and i:
            ends.append((i, False, open_))
        if i + TAIL >= len(body):
            ends.append((i + 1, quoted, open_))
    for end, inside, around in sorted(dict.fromkeys(ends), key=lambda e: -e[0]):
        closing = '"' * inside
        while around:
            closing, around = closing + around[0], around[1]
        try:
            return json.loads(body[:end] + closing, strict=False)
        except ValueError:
            continue
    return None


def parse_partial_json(text: Column | str) -> Column:
    """partial_json as a column of JSON text."""

    @F.pandas_udf("string")
    def parse(x: pd.Series) -> pd.Series:
        return pd.Series([None if (v := partial_json(t)) is None else json.dumps(v) for t in x], dtype=object)

    return parse(text)


def ratios(tp: Column | str, fp: Column | str, fn: Column | str) -> list[Column]:
    """precision, recall and f1, 0 where undefined."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def confusion(df: DataFrame, gold: Column, found: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and their ratios, by group."""
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    counts = df.groupBy(*(by or [])).agg(n(gold & found, "tp"), n(~gold & found, "fp"), n(gold & ~found, "fn"))
    return counts.select("*", *ratios("tp", "fp", "fn"))


def weighted_rollup(df: DataFrame, by: list[str], sums: list[str], means: list[str], weight: str) -> DataFrame:
    """Sums, and means weighted by a count (0 without any)."""
    mean = lambda c: F.when(F.sum(weight) > 0, F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).otherwise(0.0).alias(c)
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(mean(c) for c in means))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max."""
    q = lambda p, name: F.percentile(column, p).alias(name)
    return df.groupBy(*(by or [])).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.max(column).alias("max"))


def best_match(left: DataFrame, right: DataFrame, on: list[str], similarity: Column, threshold: float, *, left_id: str, right_id: str) -> DataFrame:
    """Each left row with the right row of its group that it is most similar to, above the threshold; ties by right id."""
    scored = left.join(right, on).withColumn("score", similarity).where(F.col("score") > threshold)
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def greedy_pairs(scored: DataFrame, by: str, threshold: float, *, left_id: str, right_id: str) -> DataFrame:
    """One-to-one pairs in each group: left rows in order take the best right row still free with the threshold at least.

    A group (one clause of one document) is a fold over its rows in order, so a task reads many groups as one stream.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}

    class Pairs:
        def __init__(self):
            self.used, self.left, self.best = set(), None, None

        def step(self, left: object, right: object, score: float) -> list[tuple]:
            out = self.end() if left != self.left else []
            self.left = left
            if right not in self.used and (self.best is None or score > self.best[1]):
                self.best = right, score
            return out

        def end(self) -> list[tuple]:
            if self.best is None:
                return []
            out = [(self.left, *self.best)]
            self.used.add(self.best[0])
            self.best = None
            return out

    rows = scored.select(by, left_id, right_id, F.col("score").cast("double").alias("score")).where((F.col("score") >= threshold) & ~F.isnan("score") & F.col(left_id).isNotNull())
    return folded(rows, Pairs, f"`{left_id}` {kinds[left_id]}, `{right_id}` {kinds[right_id]}, score double", by=by, order=[left_id, right_id], values=[left_id, right_id, "score"])


def _edits(pattern: str, text: str, anywhere: bool) -> Iterator[int]:
    """The edits between a pattern and what of a text ends at each place: with anywhere, of the best beginning, else of the text's.

    Bit-parallel (Myers): a column of differences is two numbers of as many bits as the pattern has letters.
    """
    places: dict[str, int] = {}
    for j, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << j
    full, top, first = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), 0 if anywhere else 1
    up, down, edits = full, 0, len(pattern)
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1 | first) & full, (less << 1) & full
        up, down = less | (full & ~(vertical | more)), more & vertical
        yield edits


def quote_spans(quote: str, context: str, most: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the places where a quote stands in a text with the fewest edits, ``most`` at most; without overlaps, from the left.

    One pass finds the ends; where a place begins (as late as its edits allow) is found by reading backwards from its end.
    """
    if not quote or not context:
        return []
    edits = list(_edits(quote, context, True))
    best = min(edits)
    if best > min(most, len(quote) - 1):
        return []
    out: list[tuple[int, int]] = []
    back = quote[::-1]
    for end in (i for i, n in enumerate(edits, 1) if n == best):
        before = context[max(0, end - len(quote) - best) : end][::-1]
        start = end - next(i for i, n in enumerate(_edits(back, before, False), 1) if n == best)
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def quoted_at(quote: Column | str, context: Column | str, most: int = 100) -> Column:
    """quote_spans as a column of arrays of struct<start, end>."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in quote_spans(x or "", y or "", most)] for x, y in zip(q, c, strict=True)], dtype=object)

    return spans(quote, context)
