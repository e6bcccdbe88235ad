import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as S


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def fingerprint(text, k=3):
    w = words_of(text)
    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, apart=2):
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= apart:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            ids[root(i)] = min(key, ids.get(root(i), key))
    return sorted(((key, f"{p:016x}", ids.get(root(i)), key is None or ids[root(i)] == key) for i, ((key, _), p) in enumerate(zip(docs, prints, strict=True))), key=repr)


def make(seed, n=250):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = (r.choice(docs)[1] or "").split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = f"v{r.randrange(300)}"
            text = " ".join(w)
        else:
            text = " ".join(f"É{r.randrange(300)}" for _ in range(r.choice([0, 1, 2, 3, 40, 300])))
        docs.append((n - i, text))
    return [*docs, (None, "a b c d"), (None, "null only"), (901, None), (902, " \t\v"), (903, "A B c\nd"), (903, "a b c d"), (904, "x y z " * 60_000)]


def test_equals_brute_force(spark):
    docs = make(1)
    df = spark.createDataFrame([(a, t, 1, "z") for a, t in docs], "doc_id long, text string, print int, component string").repartition(3)
    got = S.near_duplicates(df).select("doc_id", "fingerprint", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    text = "É b c"
    want = spark.range(1).select(F.xxhash64(F.lit(text.lower().replace("é", "É")))).first()[0]
    assert S.hashes(text.encode(), 3).view(np.int64).tolist() == [want]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []


def test_masks_leave_few_bits_and_lose_no_close_pair():
    levels = S.masks()
    bits = lambda m: (m & (2**64 - 1)).bit_count()
    assert [len(level) for level in levels] == [6, 18, 54, 162]
    assert {bits(m) for m in levels[0]} == {32} and min(map(bits, levels[-1])) >= 64 - S.LEFT
    r = random.Random(2)
    for _ in range(2000):
        flips = sum({1 << r.randrange(64) for _ in range(2)})
        live = range(len(levels[0]))
        for depth, level in enumerate(levels):
            live = [m for m in live if not level[m] & flips]
            assert live
            live = [3 * m + i for m in live for i in range(3)] if depth + 1 < len(levels) else live


@pytest.mark.parametrize("block", [4, S.BLOCK])
def test_large_buckets_are_split(spark, block):
    """Prints in a few tight clumps: with blocks of 4, each level is used."""
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(150):
            prints.add(center ^ sum({1 << r.randrange(64) for _ in range(r.choice([1, 1, 2, 5, 9]))}))
    prints = sorted(np.array(list(prints), np.uint64).view(np.int64).tolist())
    got = S.close_pairs(spark.createDataFrame([(p,) for p in prints], "print long"), block=block).collect()
    parent = {p: p for p in prints}

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    other = dict(parent)
    for u, v in got:
        a, b = root(parent, u), root(parent, v)
        parent[max(a, b)] = min(a, b)
    for i, u in enumerate(prints):
        for v in prints[:i]:
            if ((u ^ v) & (2**64 - 1)).bit_count() <= 2:
                a, b = root(other, u), root(other, v)
                other[max(a, b)] = min(a, b)
    assert {p: root(parent, p) for p in prints} == {p: root(other, p) for p in prints}
