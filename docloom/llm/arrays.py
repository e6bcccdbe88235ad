"""Column expressions over long arrays and long texts that stay near linear in their length.

A fold that appends to an array copies what it holds at each step, and ``substring`` walks from the first character, so
both are quadratic when used once per element. Folds here run in blocks of about the root of the array's length, and
places of a text are looked up in blocks of it. Lambdas refer to no column outside them but by two references or more,
as the optimiser would inline a column that is used once and evaluate it for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1000  # code points


def running(df: DataFrame, arrays: dict[str, Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """df with a column for each array of ints: the fold (from 0) of the elements before each element, then the fold of all.

    One element longer than the array; a null or empty array gives [0].
    """
    ints = "array<int>"
    of = lambda name, what: f"__{name}_{what}"
    each = lambda what, make: {of(n, what): make(n) for n in arrays}
    start = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast(ints).alias("out"))
    step = lambda acc, x: F.struct(combine(acc.at, x).cast("int").alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))

    def cut(name: str) -> Column:
        values = of(name, "values")
        n = F.size(values)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(values, b * width + 1, width))
        return F.when(n > 0, parts).otherwise(F.array().cast("array<array<int>>"))

    def before(name: str) -> Column:
        totals = F.transform(of(name, "parts"), lambda p: F.aggregate(p, F.lit(0), lambda a, x: combine(a, x).cast("int")))
        return F.aggregate(totals, start(F.lit(0)), step)

    def joined(name: str) -> Column:
        inner = F.zip_with(of(name, "parts"), F.col(of(name, "before")).out, lambda p, s: F.aggregate(p, start(s), step, lambda acc: acc.out))
        return F.concat(F.flatten(inner), F.array(F.col(of(name, "before")).at))

    df = df.withColumns(each("values", lambda n: F.coalesce(arrays[n].cast(ints), F.array().cast(ints))))
    df = df.withColumns(each("parts", cut)).withColumns(each("before", before))
    return df.withColumns({n: joined(n) for n in arrays}).drop(*(of(n, what) for n in arrays for what in ("values", "parts", "before")))


def in_blocks(text: Column) -> Column:
    """The text as an array of ``BLOCK`` code points each (the last may be shorter); keep it as a column of its own."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, length: Column) -> Column:
    """length code points from start (from 0) of a text kept in blocks; what lies beyond its end is left out."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(length, F.lit(0))) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start % BLOCK + 1, F.greatest(length, F.lit(0)))
