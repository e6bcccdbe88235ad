"""A record manager whose changes are atomic: a log of versions in a shared folder, each made once by whoever comes first.

A change writes its rows (key, group_id, updated_at, gone) to a folder of its own, then tries to make the next version: a small
file that names the folders a reader has to put together. Making it fails if that version is there already; then the change
is made again on the version that is there, so no writer undoes another's. Readers keep what their version names. Of rows with
one key the last version's holds, so a namespace has each key once. Every ``COMPACT`` changes, the state is written anew.

The file of a version is made by a link or rename that doesn't overwrite: atomic on local disks and HDFS; a store whose rename
overwrites needs another ``claim``.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import indexing

COMPACT = 20
ROWS = "key string, group_id string, updated_at double, gone boolean, version long"


class _Files:
    """A folder by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root)] if self.fs.exists(self.root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Makes a file with a text, whole or not at all; false if there is one of that name."""
        draft = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        try:
            if self.root.toUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), self.path(name).toUri().getPath())
                return True
            options = self.jvm.org.apache.hadoop.fs.Options
            none = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.NONE.getClass(), 1)
            none[0] = options.Rename.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(draft, self.path(name), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # what py4j raises names the Java class
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(draft, False)


Change = tuple[DataFrame | None, DataFrame | None]


@dataclass
class Records:
    """The records of a namespace in a folder. clock gives the time of changes; it has no effect that it goes back."""

    spark: SparkSession
    path: str
    namespace: str
    clock: Callable[[], float] = time.time
    retries: int = 20
    files: _Files = field(init=False)

    def __post_init__(self):
        self.folder = f"{self.path.rstrip('/')}/{urllib.parse.quote(self.namespace, safe='')}"
        self.files = _Files(self.spark, f"{self.folder}/log")
        self.files.fs.mkdirs(self.files.root)

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.files.names() if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{version:012d}.json")) if version else {"version": 0, "time": 0.0, "parts": []}

    def now(self) -> float:
        """The time, never before that of a version there is."""
        return max(float(self.clock()), self.manifest()["time"])

    def _rows(self, manifest: dict) -> DataFrame:
        if not manifest["parts"]:
            return self.spark.createDataFrame([], ROWS)
        rows = self.spark.read.schema(ROWS).parquet(*(f"{self.folder}/data/{p}" for p in manifest["parts"]))
        last = rows.groupBy("key").agg(F.max_by(F.struct("group_id", "updated_at", "gone"), "version").alias("x"), F.max("version").alias("version"))
        return last.select("key", "x.*", "version")

    def state(self, version: int | None = None) -> DataFrame:
        """(namespace, key, group_id, updated_at) as of a version (the last)."""
        rows = self._rows(self.manifest(version)).where("NOT gone")
        return rows.select(F.lit(self.namespace).alias("namespace"), "key", "group_id", "updated_at")

    def commit(self, make: Callable[[DataFrame, float], Change], at_least: float | None = None) -> int:
        """Makes a change of the state at a time: (rows to put (key, group_id), keys to take away); gives the version it has become.

        If another change comes first, ``make`` is asked again with the state after it. A clock before ``at_least`` is an error.
        """
        for _ in range(self.retries + 1):
            before = self.manifest()
            now = float(self.clock())
            if at_least is not None and now < at_least:
                raise ValueError(f"the clock gives {now}, before {at_least}")
            now, version = max(now, before["time"]), before["version"] + 1
            put, take = make(self.state(before["version"]), now)
            parts = list(before["parts"])
            for df, gone in ((put, False), (take, True)):
                if df is not None:
                    group = F.max("group_id") if "group_id" in df.columns else F.lit(None)
                    rows = df.groupBy("key").agg(group.cast("string").alias("group_id")).where("key IS NOT NULL")
                    parts.append(self._write(rows.select("key", "group_id", F.lit(now).alias("updated_at"), F.lit(gone).alias("gone"), F.lit(version).cast("long").alias("version"))))
            if len(parts) > COMPACT:
                parts = [self._write(self._rows({"parts": parts}).where("NOT gone").select(*(c.split()[0] for c in ROWS.split(", "))))]
            if self.files.claim(f"{version:012d}.json", json.dumps({"version": version, "time": now, "parts": parts})):
                return version
        raise TimeoutError(f"another change came first {self.retries + 1} times")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def update(self, keys: DataFrame, at_least: float | None = None) -> int:
        """Marks keys (key, group_id) as updated now."""
        return self.commit(lambda state, now: (keys, None), at_least)

    def delete(self, keys: DataFrame) -> int:
        return self.commit(lambda state, now: (None, keys))

    def exists(self, keys: DataFrame, name: str = "found") -> DataFrame:
        """keys with whether each is known."""
        known = self.state().select("key", F.lit(True).alias(name))
        return keys.join(known, "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def list_keys(self, **bounds) -> DataFrame:
        return indexing.list_keys(self.state(), self.namespace, **bounds)

    def index(self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], None], **how) -> dict[str, int]:
        """Indexes a batch (as ``indexing.step`` does): ``apply`` gets the documents to write to the store and the keys to delete from
        it, before the change becomes a version; it may be asked again, so it has to be an upsert. Gives the counts."""
        counts: dict[str, int] = {}

        def make(state: DataFrame, now: float) -> Change:
            step = indexing.step(batch, state, self.namespace, now, **how)
            apply(step.write, step.delete)
            counts.update(step.counts)
            seen = step.state.where(F.col("updated_at") == now).join(batch.select(F.col(how.get("key", "key")).alias("key")), "key", "left_semi")
            return seen.select("key", "group_id"), step.delete if how.get("cleanup") else None

        self.commit(make)
        return counts

