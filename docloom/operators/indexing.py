"""Incremental indexing: hash documents, skip known ones, write new ones, clean up what is gone, as one set-based plan.

State is a table (namespace, key, group_id, updated_at). ``classify`` compares a batch with it in one join on the key; ``step``
gives the new state, the documents to write and to delete, and the counts. Nothing is collected but the counts.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.numbering import numbered
from docloom.session import stored

STATE = "namespace string, key string, group_id string, updated_at double"
CLEANUPS = (None, "incremental", "full", "scoped_full")
DEALT = 64  # groups of the later rows of one key
#: Fixed value: the namespace that name-based identifiers of hashes are made in
UUID_NAMESPACE = uuid.UUID(int=1984)


def metadata_json(**fields: Column | str) -> Column:
    """A JSON object of the fields by name, with a space after commas and colons; strings are quoted, nulls are null."""

    def value(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        quoted = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.coalesce(F.nullif(quoted, F.lit("")), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}": '), value(v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def document_hash(text: Column | str, metadata: Column | str, algorithm: str = "sha256") -> Column:
    """H(H(text) + H(metadata)) in hex: sha256 and sha512 in the engine; blake2b and sha1 (as a name-based UUID) by a pandas UDF."""
    text, metadata = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (text, metadata))
    if algorithm in ("sha256", "sha512"):
        bits = int(algorithm[3:])
        return F.sha2(F.concat(F.sha2(text, bits), F.sha2(metadata, bits)), bits)
    if algorithm not in ("sha1", "blake2b"):
        raise ValueError(f"unknown algorithm {algorithm!r}")

    def one(x: str) -> str:
        if algorithm == "blake2b":
            return hashlib.blake2b(x.encode()).hexdigest()
        return str(uuid.uuid5(UUID_NAMESPACE, hashlib.sha1(x.encode(), usedforsecurity=False).hexdigest()))

    @F.pandas_udf("string")
    def hashed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(one(x) + one(y)) for x, y in zip(a, b, strict=True)])

    return hashed(text, metadata)


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with the number of each row's batch."""
    return numbered(df, [order], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def list_keys(state: DataFrame, namespace: str, *, before: float | None = None, after: float | None = None, group_ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Keys of a namespace updated before and after given times, in given groups; bounds of 0 and empty lists count as absent."""
    conditions = [F.col("namespace") == namespace]
    conditions += [F.col("updated_at") < before] if before else []
    conditions += [F.col("updated_at") > after] if after else []
    conditions += [F.col("group_id").isin(group_ids)] if group_ids else []
    found = state.where(reduce(lambda a, b: a & b, conditions)).select("key")
    return found.orderBy("key").limit(limit) if limit else found


def upsert(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """state with rows of the same key replaced. rows must have each key once."""
    return state.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def update_records(state: DataFrame, namespace: str, keys: DataFrame, now: float, at_least: float | None = None) -> DataFrame:
    """state with the keys (key, group_id) of a namespace marked as updated now; now must not be before ``at_least``."""
    if at_least is not None and now < at_least:
        raise ValueError(f"the clock gives {now}, before {at_least}")
    new = keys.groupBy("key").agg(F.max("group_id").alias("group_id")).select(F.lit(namespace).alias("namespace"), "key", "group_id", F.lit(float(now)).alias("updated_at"))
    return upsert(state, new, ["namespace", "key"])


def classify(batch: DataFrame, state: DataFrame, namespace: str, *, key: str = "key", force: bool = False, order: str | None = None) -> DataFrame:
    """batch with action: added, updated (known, forced), skipped (known), or duplicate (of an earlier row of the batch).

    The first place of each key is found by a partial aggregation; only rows at that place are numbered, and later ones of
    a key are dealt over ``DEALT`` groups, so that a key with very many rows isn't one task's. Without an order, rows are
    stored with a number, which is their order.
    """
    if order is None:
        batch = stored(batch.withColumn("__row", F.monotonically_increasing_id()), "batch")
    at = F.col(order or "__row")
    first = batch.groupBy(key).agg(F.min(at).alias("__first"))
    known = state.where(F.col("namespace") == namespace).select(F.col("key").alias(key), F.lit(True).alias("__known"))
    rows = batch.join(first, key, "left").withColumn("__late", F.coalesce(at > F.col("__first"), F.lit(False)))
    w = Window.partitionBy(key, F.when(F.col("__late"), F.pmod(F.xxhash64(at), F.lit(DEALT)))).orderBy(at)
    rows = rows.withColumn("__n", F.row_number().over(w)).join(known, key, "left")
    action = F.when((F.col("__n") > 1) | F.col("__late"), "duplicate").when(F.col("__known").isNull(), "added").otherwise("updated" if force else "skipped")
    return rows.withColumn("action", action).drop("__n", "__known", "__first", "__late", "__row")


@dataclass
class Step:
    write: DataFrame  # documents to write to the store
    delete: DataFrame  # keys to delete from it
    state: DataFrame
    counts: dict[str, int]


def step(batch: DataFrame, state: DataFrame, namespace: str, now: float, *, cleanup: str | None = None, source: str | None = None, key: str = "key", force: bool = False, order: str | None = None) -> Step:
    """Indexes one batch. cleanup: None; "incremental" and "scoped_full" delete older keys of the sources seen; "full" deletes
    all keys not seen. Incremental and scoped cleanup need a source for every document."""
    if cleanup not in CLEANUPS:
        raise ValueError(f"cleanup {cleanup!r} isn't one of {CLEANUPS}")
    if cleanup in ("incremental", "scoped_full"):
        if source is None:
            raise ValueError(f"{cleanup} cleanup needs a source column")
        if batch.where(F.col(source).isNull()).take(1):
            raise ValueError("a document has no source")
    # stored, as each is read several times, and as plans of states made of states grow with each batch
    marked = stored(classify(batch, state, namespace, key=key, force=force, order=order), "marked")
    seen = marked.where("action <> 'duplicate'").select(F.col(key).alias("key"), (F.col(source) if source else F.lit(None)).cast("string").alias("group_id"))
    gone = state.where(F.col("namespace") == namespace).join(seen.select("key"), "key", "left_anti")
    if cleanup is None:
        gone = gone.limit(0)
    elif cleanup != "full":
        gone = gone.join(seen.select("group_id").distinct(), "group_id", "left_semi")
    gone = gone.select("key")
    after = update_records(state, namespace, seen, now)
    if cleanup:
        after = after.join(gone.withColumn("namespace", F.lit(namespace)), ["namespace", "key"], "left_anti")
    after, gone = stored(after, "state"), stored(gone, "gone")
    n = {r["action"]: r["count"] for r in marked.groupBy("action").count().collect()}
    counts = {"num_added": n.get("added", 0), "num_updated": n.get("updated", 0), "num_skipped": n.get("skipped", 0) + n.get("duplicate", 0), "num_deleted": gone.count() if cleanup else 0}
    return Step(marked.where("action IN ('added', 'updated')").drop("action"), gone, after, counts)
