import hashlib
import random
import re

import pytest

from docloom.llm import decontaminate as D
from docloom.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item) if item is not None else "")
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (owners := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def make(seed=1):
    r = random.Random(seed)
    words = ["a", "b", "Ça", "déjà", "x1", "the", "7", "zo"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(i, say(r.randint(1, 30))) for i in range(20)] + [(50, None), (51, ""), (52, "..."), (None, say(15)), (3, say(14))]
    docs = [(i, say(r.randint(0, 60)) + " " + (items[r.randrange(20)][1].upper() if i % 3 == 0 else "") + say(r.randint(0, 40))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!?"), (None, docs[0][1]), (0, docs[0][1]), (0, docs[0][1]), (103, " ".join([items[0][1]] * 300))]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"slice_words": 40}, {"vocabulary": 3}])
def test_matches_brute_force(spark, how):
    docs, items = make()
    d = spark.createDataFrame([(k, t, "x", k) for k, t in docs], "doc_id long, text string, block string, term long").repartition(3)
    b = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, doc_id string")
    assert rows(Q.contamination(D.find_contamination(d, b, **how))) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    docs, items = make()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(Q.contamination(D.find_contamination(d.limit(0), b))) == []
    assert rows(Q.contamination(D.find_contamination(d, b.limit(0)))) == sorted(brute(docs, []), key=repr)


def test_small_candidate_groups_and_blocks(spark, monkeypatch):
    docs, items = make(5)
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    monkeypatch.setattr(D, "CANDIDATES", 10)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(Q.contamination(D.find_contamination(d, b))) == sorted(brute(docs, items), key=repr)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zeta some words between alpha and then beta"), (2, "alpha " + "w " * 60 + "zeta beta")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta zeta")], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near"]) for r in D.find_contamination(d, b).collect()}
    assert got == {1: ([], ["9"]), 2: ([], [])}


def test_query_returns_near_items(spark, tmp_path):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    spark.createDataFrame([(1, " ".join(reversed(words))), (2, "nothing here"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"], r["near_items"]) for r in Q.op10_inverted_index(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, "7"), 2: (0, 0, ""), 3: (0, 0, "")}


def test_a_text_with_very_many_runs_in_several_slices(spark):
    items = [(i, f"a{i} b{i} c{i}") for i in range(20)]
    text = " x ".join(items[i % 20][1] + " " + items[(i + 7) % 20][1] for i in range(15_000))
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(d, b, slice_words=10)
    assert rows(Q.contamination(found)) == sorted(brute([(1, text), (2, None)], items), key=repr)
    runs = {r["doc_id"]: r["runs"] for r in found.collect()}
    assert runs[2] == [] and runs[1] == [x for i in range(15_000) for x in (7 * i, 7 * i + 6)]
