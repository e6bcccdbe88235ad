"""The pipeline's stages against brute force, each on what its predecessor kept, over the whole smallest documents table and odd rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
import test_decontaminate
import test_neardup
import test_packing
import test_pii
import test_quality
from pyspark.sql import functions as F

import corpus_pipeline as P
from docloom.llm import pii, quality
from docloom.session import stored

SF = "/root/testdata/sf0.001"


def quality_keeps(docs):
    groups, facts = defaultdict(list), {}
    for d in docs:
        b, x = test_quality.base(d["text"])
        facts[d["doc_id"]] = (b, x, (("s", d["lang"], d["source"]), ("l", d["lang"]), ("a",)))
        if not b[-1]:
            for g in facts[d["doc_id"]][2]:
                groups[g].append(x)
    fitted = {g: test_quality.estimate(np.array(x)) for g, x in groups.items() if len(x) >= quality.LEAST}
    keep = set()
    for key, (b, x, mine) in facts.items():
        g = next((g for g in mine if g in fitted), None)
        d = 0.0
        if g:
            m, inverse, scale = fitted[g]
            d = float((np.array(x) - m) @ inverse @ (np.array(x) - m) * scale)
        if not b[-1] and d <= quality.CUTOFF:
            keep.add(key)
    return keep


def redacted(text):
    t = text or ""
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(test_pii.BASE.items()) for m in re.finditer(p, t) if test_pii.good(k, m[0])]
    near = next(k for k in pii.KINDS if k.name == "secret").near
    for m in re.finditer("[A-Za-z0-9]+", t):
        around = t[max(0, m.start() - 40) : m.start()] + " " + t[m.end() : m.end() + 25]
        if re.fullmatch("[0-9a-fA-F]{32,128}", m[0]) and re.search(near, around.lower()):
            spans.append((m.start(), 5, "secret", m.end()))
    out, at = "", 0
    for a, _, kind, b in sorted(spans):
        if b > at:
            out += t[at:a] + f"[{kind.upper()}]" if a >= at else ""
            at = b
    return text if text is None else out + t[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "word " * 30_000, "en", "src1", 150_000)], docs.schema)
    docs = stored(docs.unionByName(odd), "docs")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = stored(after, "stage")
        got = {r["doc_id"]: r.asDict() for r in docs.collect()}
        texts = [(d["doc_id"], d["text"]) for d in before]
        if name == "quality rules":
            want = quality_keeps(before)
        elif name == "near-duplicates":
            want = {r[0] for r in test_neardup.brute(texts, 5) if r[3]}
        elif name == "decontamination":
            want = {r[0] for r in test_decontaminate.brute(texts, items) if not r[5]}
        else:
            want = {k for k, _ in texts}
            assert all(got[k]["text"] == redacted(t) and got[k]["n_chars"] == len(got[k]["text"]) for k, t in texts)
        assert set(got) == want, name
        assert 0 < len(want) < len(before) or name == "personal data", name
    rows = P.STAGES[-1][1](spark, docs, SF)
    final = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert test_packing.verify(rows.drop("ids").collect(), final, 2048) < 2048 * docs.rdd.getNumPartitions()


def test_stage_list_and_empty_table(spark):
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
        docs = out if stage is not P.packed else docs


@pytest.mark.parametrize("text", ["mail a@b.co, card 4111 1111 1111 1111"])
def test_redaction_twice_changes_nothing_more(spark, text):
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    once = P.personal_data(spark, df, SF)
    assert once.first() == P.personal_data(spark, once, SF).first() and once.select(F.length("text") == F.col("n_chars")).first()[0]


def test_null_and_shared_ids_and_missing_columns(spark):
    say = lambda x, n=80: " ".join(f"{x}{i}" for i in range(n))
    docs = [(None, say("a")), (1, say("a")), (1, say("b")), (1, say("b")), (2, say("b") + " more"), (3, "too short"), (None, "too short"), (3, say("c")), (None, say("d")), (None, say("d") + " end")]
    df = stored(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, distance string"), "docs")
    value = lambda df: sorted(((r["doc_id"] or 0), r["text"]) for r in df.collect())
    good = P.quality_rules(spark, df, SF)
    assert good.columns == df.columns and value(good) == sorted((k or 0, t) for k, t in docs if t != "too short")
    one = P.near_duplicates(spark, stored(good, "stage"), SF)
    assert one.columns == df.columns and len(value(one)) == 4
    assert {(1, say("a")), (1, say("b")), (3, say("c"))} < set(value(one)) and {t for k, t in value(one) if not k} < {say("d"), say("d") + " end"}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    mixed = spark.createDataFrame([(None, item, "x"), (7, item, "x"), (7, say("e"), "x"), (None, None, "x")], df.schema)
    assert {(r["doc_id"], r["text"]) for r in P.decontamination(spark, mixed, SF).collect()} == {(None, None), (7, say("e"))}
    assert P.personal_data(spark, mixed, SF).columns == df.columns


def test_near_duplicates_miss_no_link_of_their_measure(spark):
    """sf0.01: the groups that all pairs with a similarity of 0.8 on five-word shingles give, by SQL; the stage keeps one of each."""
    import duckdb

    from docloom.llm import sql

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    groups = {r[0]: r[2] for r in c.sql(sql.NEAR_DUPLICATES.replace("least(2, ", "least(5, ")).fetchall()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with_words = {r["doc_id"] for r in docs.where("text rlike '[^ \\t-\\r]'").select("doc_id").collect()}
    kept = [r["doc_id"] for r in P.near_duplicates(spark, docs, folder).collect()]
    assert sorted(k for k in kept if k in with_words) == sorted({groups[k] for k in with_words})
    assert sum(groups[k] != k for k in with_words) > 20  # so the recall of links is 1, not of none
