"""Separator scan: document boundaries of flat, unindexed token files, found in blocks and stitched by a prefix scan.

A flat file is nothing but little-endian unsigned token ids, with an end-of-document id after each document. Blocks
(path, offset, length) are scanned independently: one vector comparison and one search for the end ids of a block. An
exclusive prefix scan over the blocks' summaries (ends so far, last end so far) then gives each block the number of its
first document and where that document started, which may be many blocks earlier. Only summaries of 40 bytes a block meet
in the scan; ends stay with their block. A block holds ``BLOCK`` tokens (2 MB) however long the file is.

Files are listed by Spark's binary reader (sizes only) and read at an offset through pyarrow.fs, which takes
file, hdfs, viewfs, s3, abfs and gs paths. A folder is made a full path by Hadoop's file system first, so one without a scheme is
in the cluster's default file system for writer and readers alike. An id takes two bytes where the vocabulary has no id beyond
65,535, else four; an id that doesn't fit the width asked for is an error.

Defined cases: an empty file has no documents; documents may be empty; tokens after the last end id are an unclosed
document; bytes after the last whole id are ignored; null texts are empty documents; other columns of a table are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.files import opened, qualified
from docloom.llm.tokens import Encoder, default_vocabulary
from docloom.session import fresh_path, stored

END = 50256
BLOCK = 1 << 20
WIDTH = 2  # bytes of an id


def width_of(vocabulary: str | None = None) -> int:
    """Bytes of an id that hold every id of a vocabulary."""
    return 2 if Encoder(vocabulary or default_vocabulary()).most < 1 << 16 else 4


def fixed(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"token id {int(ids.max())} doesn't fit {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def write_flat(docs: DataFrame, folder: str, *, text: str = "text", vocabulary: str | None = None, end: int = END, width: int = WIDTH) -> DataFrame:
    """Encodes texts, in their partitions' order, into one flat file for each partition. Runs at once; gives (path, docs, tokens).

    folder: as ``qualified`` gives it. A task writes under a name of its own and then renames, so a repeated or doubled task leaves one whole file. A text
    that spells the end token is encoded as ordinary text.
    """
    path = vocabulary or default_vocabulary()
    tail = fixed(np.array([end], np.int64), width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        encoder.special = ()
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        name, own = f"{top}/tokens-{TaskContext.get().partitionId():06d}.bin", f"{top}/_{uuid.uuid4().hex}"
        n = size = 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for body in batch.column(0):
                    ids = fixed(np.frombuffer(encoder.encode(body.as_py()), "<u4"), width) + tail
                    out.write(ids)
                    n, size = n + 1, size + len(ids) // width
        fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["path", "docs", "tokens"])

    return stored(docs.select(text).mapInArrow(write, "path string, docs bigint, tokens bigint"), "flat")


def blocks(spark: SparkSession, folder: str, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(path, block, offset, length) over all files of a folder, in tokens."""
    files = spark.read.format("binaryFile").load(folder).select("path", (F.col("length") / width).cast("long").alias("size")).where("size > 0")
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
    return cut.select("path", "block", (F.col("block") * block).alias("offset"), F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block).alias("length"))


def scan(cut: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """Each block's end ids: ends (places in the block), n_ends and last_end (place in the file)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    f.seek(offset * width)
                    ids = np.frombuffer(f.read(length * width), f"<u{width}")
                ends = np.flatnonzero(ids == end).astype(np.int32)
                last = offset + int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([number]), pa.array([offset]), pa.array([length]), pa.array([len(ends)]), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int32()))],
                    ["path", "block", "offset", "length", "n_ends", "last_end", "ends"],
                )

    # blocks are dealt out evenly: their number doesn't follow from the size of the listing
    n = cut.sparkSession.sparkContext.defaultParallelism * 4
    return cut.repartition(n, "path", "block").mapInArrow(find, "path string, block bigint, offset bigint, length bigint, n_ends bigint, last_end bigint, ends array<int>")


def documents(spark: SparkSession, folder: str, *, end: int = END, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """A row for each document: path, doc_no (within its file), start, n_tokens (without the end id), closed."""
    found = stored(scan(blocks(spark, folder, block, width), end, width), "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("path", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first_doc"), (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("open_start"))
    rows = found.where("n_ends > 0").join(stored(stitched, "stitched"), ["path", "block"])
    rows = rows.select("path", "offset", "first_doc", "open_start", F.posexplode("ends").alias("i", "at"), "ends")
    start = F.when(F.col("i") == 0, F.col("open_start")).otherwise(F.col("offset") + F.get("ends", F.col("i") - 1) + 1)
    closed = rows.select("path", (F.col("first_doc") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("offset") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = found.groupBy("path").agg(F.sum("n_ends").alias("doc_no"), (F.coalesce(F.max("last_end"), F.lit(-1)) + 1).alias("start"), F.max(F.col("offset") + F.col("length")).alias("size"))
    return closed.unionByName(tail.where("start < size").select("path", "doc_no", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def scan_table(docs: DataFrame, *, vocabulary: str | None = None, end: int = END, **how) -> DataFrame:
    """Writes a table's texts as flat token files in the shared folder and scans them; file_no is the file's number."""
    spark, width = docs.sparkSession, width_of(vocabulary)
    folder = qualified(spark, fresh_path(spark, "tokens"))
    if not write_flat(docs, folder, vocabulary=vocabulary, end=end, width=width, **how).take(1):  # a table without partitions
        return spark.createDataFrame([], "file_no int, doc_no bigint, start bigint, n_tokens bigint, closed boolean")
    found = documents(spark, folder, end=end, width=width)
    return found.select(F.regexp_extract("path", r"tokens-(\d+)\.bin$", 1).cast("int").alias("file_no"), "doc_no", "start", "n_tokens", "closed")
