"""Histogram sort: shards of nearly equal bytes by splitters found from exact histograms, then one exchange.

Rows are ordered by a hash of their key. A splitter is a boundary in that order with a given share of all bytes below
it. Each round counts the exact bytes between the current probes (4096 in each interval that is still open, for all
splitters at once) and narrows every interval to the probes around its target, until the target is met within the
tolerance or the interval holds one place. Only histograms reach the driver: 4096 sums for a splitter at most.

Rows with the same key hash are told apart by their place in the stored table, so one key may hold any share of the rows.
Slots within a shard come from counts of (shard, key range, place range) and a row number within each: a key range (of
4096) with more than its share of rows is cut into as many place ranges as it has shares, so that no group, and no task,
holds much more than a 4096th of the rows. There are 12 thousand groups at most.

Defined cases: null keys are one key; an empty table gives an empty result; fewer rows than shards leave shards empty; a
row larger than a shard's share gets a shard nearly to itself. Input columns named shard or slot are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import stored

SHARDS = 40
TOLERANCE = 0.001  # of a shard's bytes, either side of a splitter
DIGIT = 12
LEVELS = (("__hash", 48), ("__hash", 36), ("__hash", 24), ("__hash", 12), ("__hash", 0), ("__place", 24), ("__place", 12), ("__place", 0))


def _prefix(level: int) -> Column:
    """A row's place among the probes of a level: its leading digits of (hash, place)."""
    name, shift = LEVELS[level]
    return F.concat_ws(":", F.col("__hash"), F.shiftright(name, shift)) if name == "__place" else F.shiftright(name, shift).cast("string")


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The boundaries (hash, place) of shards 1, 2, ...: a row belongs to a shard from its boundary on."""
    width = 1 << DIGIT
    total, found = None, {}
    #: parent prefix -> (first hash, first place, bytes below, splitters inside)
    open_: dict[str, tuple[int, int, int, list[int]]] = {"": (0, 0, 0, list(range(1, shards)))}
    for level, (name, shift) in enumerate(LEVELS):
        part = rows if not level else rows.where(_prefix(level - 1).isin(list(open_)))
        parent = F.lit("") if not level else _prefix(level - 1)
        digit = F.shiftright(name, shift).bitwiseAND(F.lit(width - 1))
        sums = part.groupBy(parent.alias("parent"), digit.alias("digit")).agg(F.sum("__size").alias("bytes")).collect()
        if total is None:
            total = sum(r["bytes"] for r in sums)
            slack = tolerance * total / shards
        below: dict[str, list[tuple[int, int]]] = {}
        for r in sorted(sums, key=lambda r: (r["parent"], r["digit"])):
            below.setdefault(r["parent"], []).append((r["digit"], r["bytes"]))
        nexts: dict[str, tuple[int, int, int, list[int]]] = {}
        for prefix, (h, p, base, inside) in open_.items():
            for s in inside:
                target, at = total * s / shards, base
                for d, b in below.get(prefix, ()):
                    if at + b >= target or (d, b) == below[prefix][-1]:
                        break
                    at += b
                else:
                    found[s] = (h, p)
                    continue
                first = (h + (d << shift), 0) if name == "__hash" else (h, p + (d << shift))
                last = (first[0] + (1 << shift), 0) if name == "__hash" else (h, first[1] + (1 << shift))
                low, high = target - at, at + b - target
                if min(low, high) <= slack or level + 1 == len(LEVELS):
                    found[s] = first if low <= high else last
                    continue
                key = str(first[0] >> shift) if name == "__hash" else f"{h}:{first[1] >> shift}"
                nexts.setdefault(key, (*first, at, []))[3].append(s)
        open_ = nexts
        if not open_:
            break
    return [found[s] for s in sorted(found)]


def _parts(rows: DataFrame) -> Column:
    """A row's place range: 0, or leading bits of its place where its key range holds more than a share of the rows."""
    sizes = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    share = max(64, sum(sizes.values()) / (1 << DIGIT))
    bits = {k: min(36, math.ceil(math.log2(n / share))) for k, n in sizes.items() if n > 2 * share}
    if not bits:
        return F.lit(0).cast("long")
    own = F.try_element_at(F.create_map(*(F.lit(x) for k, b in bits.items() for x in (k, 36 - b))), F.col("__range"))
    # the shift of a column by a column isn't in the functions; a power of two divides as well
    return F.when(own.isNull(), F.lit(0)).otherwise(F.floor(F.col("__place") / F.pow(F.lit(2.0), own))).cast("long")


def shard(df: DataFrame, *, key: list[str], size: Column, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """df with columns shard (0 to shards - 1) and slot (gapless from 0 within a shard). df is stored once, as it comes."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.withColumns({
        "__size": size.cast("long"),
        "__hash": F.shiftrightunsigned(F.xxhash64(*key), 4),
        "__place": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 28),
    })
    rows = stored(rows, "keyed")
    cuts = splitters(rows.select("__hash", "__place", "__size"), shards, tolerance)
    bounds = F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(p).cast("long").alias("p")) for h, p in cuts))
    here = F.struct(F.col("__hash").alias("h"), F.col("__place").alias("p"))
    number = F.size(F.filter(bounds, lambda b: b <= here)) if cuts else F.lit(0)
    rows = rows.withColumns({"shard": number.cast("int"), "__range": F.shiftright("__hash", 48)})
    rows = rows.withColumn("__part", _parts(rows))
    group = ["shard", "__range", "__part"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(*group).orderBy("__hash", "__place"))
    placed = rows.withColumn("__within", within).join(F.broadcast(first), group)
    return placed.select(*names, "shard", (F.col("__first") + F.col("__within") - 1).cast("long").alias("slot"))
