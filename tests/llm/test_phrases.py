import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import phrases as P


def brute(docs, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = {(p[i:j], c) for p, c in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        rows = []
        for p, a in found.items():
            if (p, a) not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def make(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "É", "New", "york", "city", "c#", "a\xa0b", "\x00z", "日本"] + [f"w{i}" for i in range(40)]
    docs = []
    for _ in range(400):
        words = []
        while len(words) < r.choice([1, 5, 60]):
            words += r.choice([["new", "York", "city", "of", "light"], ["the"], ["the", "the"], [r.choice(vocabulary)], [r.choice(vocabulary)]])
        docs.append((r.choice(["en", "de", None, "en"]), "".join(w + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0c"]) for w in words)))
    return [*docs, ("fr", None), ("fr", ""), (None, "..!"), ("en", "hot spot " * 20_000), ("en", "the"), *[("en", "same old passage that is repeated. Again")] * 150]


@pytest.mark.parametrize("limit,few,chunk", [(None, 4_000_000, 500_000), (3, 4_000_000, 700), (3, 0, 700), (20_000, 10, 500_000)])
def test_equals_brute_force(spark, monkeypatch, limit, few, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "HELD", 2 * chunk)
    docs = make(1)
    df = spark.createDataFrame([(a, t, 1, "z") for a, t in docs], "lang string, text string, a int, id string").repartition(3)
    got = P.collocations(df, limit=limit, few=few)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_ranks_are_cut_alike_by_any_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 4)
    docs = make(2)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, P.collocations(df, top=7, least=20).collect())) == brute(docs, 20, 7)


def test_no_rows_and_no_language(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(empty).collect() == []
    one = spark.createDataFrame([("a b c",)] * 100, "text string")
    assert [r["phrase"] for r in P.collocations(one).collect()] == ["a b c"]


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**13, 10**15, 2 * 10**13, 3 * 10**13
    df = spark.createDataFrame([(a, n, (left, right))], "a long, n long, c struct<l:long,r:long>")
    c = F.col("c")
    assert df.select(P._score(F.col("a"), F.col("n"), c)).first()[0] == 1000 * a * n // (left * right)


def test_growth_is_depth_first():
    rows = np.array(sorted([(1, 2, 3, 4, 5), (1, 2, 3, 9, 0), (1, 2, 0, 0, 0), (1, 7, 8, 0, 0)]), np.int64)
    got = list(P.grown(list(rows.T), np.array([1, 3, 2, 1], np.int64), 1, 3))
    assert dict((tuple(k), v) for k, v in got) == {(1, 2): 6, (1, 2, 3): 5, (1, 2, 3, 4): 3, (1, 2, 3, 4, 5): 3}


def test_pointers_are_of_three_words_that_can_be_frequent(spark, monkeypatch):
    """All pairs of twelve words are frequent, next to no three of them: the passage alone leaves pointers."""
    seen, stored = {}, P.stored

    def kept(df, name, **how):
        seen[name] = stored(df, name, **how)
        return seen[name]

    monkeypatch.setattr(P, "stored", kept)
    r = random.Random(5)
    docs = [("en", " ".join(r.choice("abcdefghijkl") for _ in range(100))) for _ in range(300)] + [("en", "this passage is copied often")] * 100
    got = P.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == brute(docs)
    assert seen["pairs"].count() == 148 and seen["pointers"].count() == 3
    monkeypatch.setattr(P, "BUCKETS", (6, 6))  # buckets that many phrases share
    monkeypatch.setattr(P, "BLOCKS", 8)
    assert sorted(map(tuple, P.collocations(spark.createDataFrame(docs, "lang string, text string")).collect())) == brute(docs)
