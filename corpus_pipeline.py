"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A stage names
rows by a hash of what its verdict rests on (id, text, language and source) and removes rejected ones by an anti join on
it, so rows that share an id are judged each by its own text, and a row with a null id like any other.

Defined cases: a table without lang or source has one group of each; n_chars follows the text where there is such a
column; of rows with the same id, text, language and source one stays, if they have words; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, neardup, packing, pii, quality
from docloom.llm.queries import contamination
from docloom.session import stored, table

ROW = "__row"
GROUPS = ("lang", "source")
FEW = 500_000  # row names that are broadcast: some 20 MB


def _named(docs: DataFrame) -> DataFrame:
    """docs with ROW. A hash skips nulls, so it takes in which columns are null."""
    given = ["doc_id", "text", *(c for c in GROUPS if c in docs.columns)]
    return docs.withColumn(ROW, F.xxhash64(*given, *(F.col(c).isNull() for c in given)))


def _few(rows: DataFrame) -> DataFrame:
    """Names of rows (stored), broadcast while they are few; a shuffle join takes any number."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _named(docs).join(_few(rows), ROW, "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't outliers of their language and source."""
    groups = [c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in GROUPS]
    rows = quality.with_statistics(_named(docs).select(ROW, "text", *groups))
    rows = stored(rows.drop("text"), "statistics")
    judged = quality.judge(rows, quality.fit(rows))
    return _without(docs, stored(judged.where("NOT kept").select(ROW).distinct(), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id): five-word shingles, similarity 0.8."""
    named = _named(docs)
    found = neardup.near_duplicates(named.select(ROW, "text"), key=ROW).where("n_shingles > 0")
    found = stored(found.groupBy(ROW).agg(F.first("component_id").alias("component"), F.count("*").alias("copies")), "found")
    ids = found.join(named.select(ROW, "doc_id").distinct(), ROW)
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("x"))
    kept = stored(first.select(F.col(f"x.{ROW}").alias(ROW)), "first")
    out = named.join(_few(stored(found.join(kept, ROW, "left_anti").select(ROW), "duplicates")), ROW, "left_anti")
    repeated = stored(found.join(kept, ROW, "left_semi").where("copies > 1").select(ROW), "repeated")
    if repeated.take(1):
        repeated = _few(repeated)
        out = out.join(repeated, ROW, "left_anti").unionByName(out.join(repeated, ROW, "left_semi").dropDuplicates([ROW]))
    return out.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of the benchmark."""
    found = contamination(decontaminate.find_contamination(_named(docs).select(ROW, "text"), table(spark, sf_dir, "benchmark"), key=ROW), key=ROW)
    return _without(docs, stored(found.where("contaminated").select(ROW).distinct(), "contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Concentration steps and the tokenizer can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = stored(docs, "stage")
    return docs
