"""Sources and sinks: text, JSON, CSV, XML and binary files, blobs by kind, keyed stores, vector tables, reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "id string, text string, metadata map<string,string>"
#: kinds of files by extension
MIME = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "xml": "application/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "zip": "application/zip", "py": "text/x-python"}


def text_files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """A document for each file, its path as source."""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive)
    read = read.option("pathGlobFilter", glob) if glob else read
    return read.load(path).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"), F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def documents(df: DataFrame, text: str, source: Column | str | None = None, id_: str | None = None) -> DataFrame:
    """Documents of a table: one column is the text, the others (as strings) and the source are metadata."""
    rest = [c for c in df.columns if c not in (text, id_)]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    if source is not None:
        pairs += [F.lit("source"), (F.col(source) if isinstance(source, str) else source).cast("string")]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select((F.col(id_).cast("string") if id_ else F.lit(None).cast("string")).alias("id"), F.col(text).cast("string").alias("text"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"))


def csv_documents(spark: SparkSession, path: str, schema: str | StructType, text: str | None = None, **options) -> DataFrame:
    """A document for each row: the text column, or "name: value" lines of all columns."""
    df = spark.read.options(header=True, multiLine=True, escape='"', **options).schema(schema).csv(path)
    if text:
        return documents(df, text)
    body = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    return df.select(F.lit(None).cast("string").alias("id"), body.alias("text"), F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"))


def json_documents(spark: SparkSession, path: str, content: str, schema: str | StructType | None = None, multi_line: bool = True) -> DataFrame:
    read = spark.read.option("multiLine", multi_line)
    df = (read.schema(schema) if schema else read).json(path)
    return df.select(F.lit(None).cast("string").alias("id"), F.col(content).cast("string").alias("text"), F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | StructType | None = None) -> DataFrame:
    read = spark.read.format("xml").option("rowTag", row_tag)
    return (read.schema(schema) if schema else read).load(path)


def blobs(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modified, length, content, mime_type (by extension) of files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    df = (read.option("pathGlobFilter", glob) if glob else read).load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", "content", mime_type("path").alias("mime_type"))


def mime_type(path: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def source_of(metadata: Column | str, path: Column | str) -> Column:
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.try_element_at(m, F.lit("source")), path if isinstance(path, Column) else F.col(path))


def decoded(content: Column | str, encoding: str = "UTF-8") -> Column:
    return F.decode(content, encoding)


#: first bytes of kinds of files, in hexadecimal
MAGIC = {"docx": "504B0304", "doc": "D0CF11E0A1B11AE1", "rtf": "7B5C727466", "pdf": "25504446"}


def sniffed(content: Column | str) -> Column:
    """The kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), "")
    for name, magic in MAGIC.items():
        out = out.when(head.startswith(magic), name)
    return out.otherwise("unknown")


def found_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files by glob, newest first. Only metadata is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path")


def grep(rows: DataFrame, pattern: str, *, mode: str = "content", path: str = "path", line: str = "line") -> DataFrame:
    """Lines that match: "content" all of them, "files_with_matches" their paths, "count" their number by path."""
    re.compile(pattern)
    hits = rows.where(F.col(line).rlike(pattern))
    if mode == "content":
        return hits
    if mode == "files_with_matches":
        return hits.select(path).distinct()
    if mode == "count":
        return hits.groupBy(path).agg(F.count("*").alias("n"))
    raise ValueError(f"unknown mode {mode!r}")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with rows of equal keys replaced; rows without a key get a random one."""
    rows = rows.withColumn(key, F.coalesce(key, F.expr("uuid()"))) if dict(rows.dtypes)[key] == "string" else rows
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame | list | None, key: str = "id") -> DataFrame:
    """table without the keys; None deletes nothing, missing keys are ignored."""
    if keys is None:
        return table
    if isinstance(keys, list):
        return table.where(~F.coalesce(F.col(key).isin(keys), F.lit(False)))
    return table.join(keys.select(key), key, "left_anti")


def update(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with the values that rows give (not null) for keys that it has."""
    new = rows.select(key, *(F.col(c).alias(f"__{c}") for c in rows.columns if c != key))
    return table.join(new, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in new.columns else F.col(c) for c in table.columns))


def get(table: DataFrame, *, ids: list | None = None, where: Column | None = None, key: str = "id", columns: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = table if ids is None else table.where(F.col(key).isin(ids))
    df = (df if where is None else df.where(where)).orderBy(key)
    df = df.offset(offset) if offset else df
    df = df if limit is None else df.limit(limit)
    return df.select(*columns) if columns else df


_KEY = re.compile(r"[a-zA-Z0-9_\-./]+")


def checked_key(key: str) -> str:
    """A store key that can be a relative path; one that leaves the store is an error."""
    if not _KEY.fullmatch(key) or key.startswith("/") or ".." in key.split("/"):
        raise ValueError(f"bad key {key!r}")
    return key


class KeyedStore:
    """Keys and values in a table of versions: each change writes a new Parquet folder, so readers keep what they have."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0):
        self.spark, self.path, self.version = spark, path, version

    def rows(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "key string, value binary")
        return self.spark.read.schema("key string, value binary").parquet(f"{self.path}/v{self.version}")

    def _next(self, df: DataFrame) -> KeyedStore:
        df.write.parquet(f"{self.path}/v{self.version + 1}")
        return KeyedStore(self.spark, self.path, self.version + 1)

    def set(self, rows: DataFrame) -> KeyedStore:
        return self._next(upsert(self.rows(), rows, "key"))

    def delete(self, keys: DataFrame | list) -> KeyedStore:
        return self._next(delete(self.rows(), keys, "key"))

    def get(self, keys: DataFrame) -> DataFrame:
        """A row for each requested key (key, pos); null values for missing ones."""
        return keys.join(self.rows(), "key", "left")

    def keys(self, prefix: str = "") -> DataFrame:
        return self.rows().where(F.col("key").startswith(prefix)).select("key")


def write_report(df: DataFrame, path: str, title: str) -> None:
    """JSON rows at path/json and a Markdown table at path/markdown; a report has a few rows."""
    df.write.mode("overwrite").json(f"{path}/json")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    body = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "n int, value string").unionByName(df.select(F.lit(len(head)).alias("n"), row.alias("value")))
    body.coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(f"{path}/markdown")


class EncodedStore:
    """A keyed store of other values: keys and values are columns' encodings (keys to strings, values to JSON bytes and back)."""

    def __init__(self, store: KeyedStore, schema: str, encode: Callable[[Column], Column] | None = None):
        self.store, self.schema, self.encode = store, schema, encode or (lambda k: F.sha2(k.cast("string"), 256))

    def set(self, rows: DataFrame, key: str, values: list[str]) -> EncodedStore:
        coded = rows.select(self.encode(F.col(key)).alias("key"), F.encode(F.to_json(F.struct(*values)), "UTF-8").alias("value"))
        return EncodedStore(self.store.set(coded), self.schema, self.encode)

    def get(self, keys: DataFrame, key: str) -> DataFrame:
        """A row for each requested key, with the value's columns; nulls for missing ones."""
        found = keys.withColumn("__key", self.encode(F.col(key))).join(self.store.rows(), F.col("__key") == F.col("key"), "left")
        return found.select(*keys.columns, F.from_json(F.decode("value", "UTF-8"), self.schema).alias("__v")).select(*keys.columns, "__v.*")

    def delete(self, keys: DataFrame, key: str) -> EncodedStore:
        return EncodedStore(self.store.delete(keys.select(self.encode(F.col(key)).alias("key"))), self.schema, self.encode)


def dump_vectors(table: DataFrame, path: str) -> None:
    """A vector table as JSON rows."""
    table.write.mode("errorifexists").json(path)


def load_vectors(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def forked(table: DataFrame, path: str) -> DataFrame:
    """A copy of a table under another name: later changes of either don't show in the other."""
    table.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def stringified(content: Column, kind: str) -> Column:
    """Scanned content as text: strings as they are, anything else as JSON."""
    return content if kind == "string" else F.to_json(content) if kind.startswith(("struct", "map", "array")) else content.cast("string")


def examples(rows: DataFrame, content_key: str, *, key: str = "example_id", where: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents of a dataset's examples: the text is what a dotted key leads to, strings as they are and anything else as JSON; the rest is metadata."""
    df = rows if where is None else rows.where(where)
    if limit is not None or offset:
        df = df.orderBy(key)
        df = df.offset(offset) if offset else df
        df = df if limit is None else df.limit(limit)
    kind = df.select(F.col(content_key).alias("c")).schema["c"].dataType.simpleString()
    rest = F.to_json(F.struct(*(c for c in df.columns if c != key)))
    return df.select(F.col(key).cast("string").alias("id"), stringified(F.col(content_key), kind).alias("text"), F.create_map(F.lit("example"), rest).alias("metadata"))


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows for a vector table of images: id and text are the file's content in base 64 and its path is metadata."""
    files = blobs(spark, path, glob=glob)
    return files.select(F.sha2("content", 256).alias("id"), F.base64("content").alias("text"), F.create_map(F.lit("uri"), F.col("path")).alias("metadata"))


def document_store(store: KeyedStore) -> EncodedStore:
    """A keyed store of documents (text and metadata) under their ids as they are."""
    return EncodedStore(store, "text string, metadata map<string,string>", lambda k: k.cast("string"))


def write_log(events: DataFrame, path: str, *, time: str = "ts", event: str = "event", run: str = "run_id", data: str = "data") -> None:
    """An event log as text lines, in order of time within each file."""
    line = F.concat_ws(" ", F.col(time).cast("string"), event, F.col(run).cast("string"), data)
    events.sortWithinPartitions(time, event).select(line.alias("value")).write.mode("append").text(path)
