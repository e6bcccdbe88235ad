import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docloom.llm import queries as Q
from docloom.llm import sharding as S


def check(rows, docs, shards, largest):
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows) == sorted((k is None, k or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs)
    of = defaultdict(list)
    for r in rows:
        of[r["shard"]].append(r)
    total = sum(r["size"] for r in rows)
    for s, part in of.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in part) == list(range(len(part)))
    for s in range(shards):
        assert abs(sum(r["size"] for r in of[s]) - total / shards) <= total / shards * 0.002 + largest


def test_near_equal_bytes(spark):
    r = random.Random(1)
    docs = [(i, "é" * r.choice([0, 1, 50, 400])) for i in range(3000)] + [(5000, None), (5001, ""), (None, "x"), (None, "x"), (3, "again")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, __n int").repartition(3)
    rows = Q.shards(df).collect()
    check(rows, docs, 40, 816)
    assert len({r["shard"] for r in rows}) == 40 and {r["law"] for r in rows} == {"bytes"}
    assert Q.shards(df.limit(0)).collect() == []


def test_one_key_and_one_large_row(spark):
    docs = [(7, "same")] * 900 + [(i, "other") for i in range(100, 400)]
    rows = Q.shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check(rows, docs, 40, 21)
    few = [(1, "x" * 10_000), (2, "y"), (3, "z")]
    check(Q.shards(spark.createDataFrame(few, "doc_id long, text string")).collect(), few, 40, 10_016)


def test_other_shard_counts(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    for n in (1, 7):
        got = S.shard(df, key=["doc_id"], size=F.lit(1), shards=n).groupBy("shard").count().collect()
        assert len(got) == n and max(r["count"] for r in got) <= 500 / n + 1


def test_shards_are_ranges_of_the_sorted_hashes(spark):
    """Brute force: sort all rows by hash and cut at equal bytes; splitters must lie where that cuts, within the tolerance."""
    df = spark.range(20_000).select((F.col("id") % 9000).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text")).repartition(5)
    rows = S.shard(df, key=["doc_id"], size=F.octet_length("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 4)).collect()
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["h"] for r in order] == sorted(r["h"] for r in rows)
    total = at = 0
    everything = sum(len(r["text"]) for r in rows)
    for i, r in enumerate(order):
        if i and r["shard"] != order[i - 1]["shard"]:
            for s in range(order[i - 1]["shard"] + 1, r["shard"] + 1):
                assert abs(total - everything * s / 40) <= 0.001 * everything / 40 + 200
                at += 1
        total += len(r["text"])
    assert at == 39


def test_hot_key_is_cut_into_many_places(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.lit(7).alias("shard"), F.lit("x").alias("slot")).repartition(4)
    got = S.shard(rows, key=["k"], size=F.lit(1))
    assert sorted(got.columns) == ["k", "shard", "slot"]
    keyed = rows.withColumns({"__hash": F.shiftrightunsigned(F.xxhash64("k"), 4), "__place": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 28)}).withColumn("__range", F.shiftright("__hash", 48))
    assert keyed.groupBy("__range", S._parts(keyed)).count().agg(F.max("count")).first()[0] < 300
    for s, part in Counter(r["shard"] for r in got.collect()).items():
        assert 0 <= s < 40 and abs(part - 1500) <= 5
