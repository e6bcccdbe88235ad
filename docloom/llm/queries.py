"""The queries of this subpackage: each applies an operator to its whole table and returns the columns agreed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, dialogues, neardup, packing, phrases, pii, quality, sharding, simhash, sql, tokenscan, toxicity, urls, warc
from docloom.session import stored, table


def contamination(found: DataFrame, key: str = "doc_id", near: bool = False) -> DataFrame:
    """near: with the items whose rarest words lie near each other, too."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *((F.size("near").cast("long").alias("n_near_items"), F.array_join(F.array_sort("near"), ",").alias("near_items")) if near else ()),
    )


def op10_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), near=True)


def op2_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = pii.with_spans(df.select(key, text), text, "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.as_text(pii.base(F.col("found"))), 256).alias("base_sha256"), pii.as_text(F.col("found")).alias("spans"))


def op9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op1_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record, and the metadata and conversion records derived from it."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", F.octet_length("block").cast("long").alias("content_length"), F.crc32("record").alias("record_crc32"))


def shards(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    placed = sharding.shard(rows, key=["doc_id"], size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_host_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def quality_rules(docs: DataFrame) -> DataFrame:
    rows = stored(quality.with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    judged = quality.judge(rows, quality.fit(rows))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenscan.scan_table(table(spark, sf_dir, "documents"))


FOLDS = 5


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    fold = lambda c: F.crc32(F.col(c).cast("string")) % FOLDS
    model = toxicity.learn(docs, labels.where(fold("doc_id") != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_pattern_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_retained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.audited(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_derivatives": op1_derivatives,
    "op2_setsketch": op2_setsketch,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_host_trie": op4_host_trie,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_separator_scan": op6_separator_scan,
    "op7_levenshtein": op7_levenshtein,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_spans": op9_spans,
    "op10_inverted_index": op10_inverted_index,
    "op11_simhash": op11_simhash,
    "op12_pattern_growth": op12_pattern_growth,
    "op13_retained_turns": op13_retained_turns,
}
SQL: dict[str, str] = dict(sql.SQL)
