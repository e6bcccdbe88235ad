import random

import numpy as np
import pytest

from docloom.llm import neardup as N
from docloom.llm import sketch as S
from docloom.llm.components import components


def sets_of(text, k):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return {tuple(out)} if 0 < len(out) < k else {tuple(out[i : i + k]) for i in range(len(out) - k + 1)}


def brute(docs, k):
    sets = {key: sets_of(t, k) for key, t in docs}
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((a, len(sets[a]), root(a), root(a) == a) for a in keys)


def make(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "I"]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            words = (r.choice(docs)[1] or "").split()
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
            text = text.upper() if r.random() < 0.1 and text.isascii() else text
        else:
            text = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 8, 30, 80])))
        docs.append((i, text))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, " one"), (n + 6, "x y " * 3000)]


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    docs = make(k)
    df = spark.createDataFrame([(a, t, "z", 1) for a, t in docs], "doc_id long, text string, id string, n int").repartition(3)
    got = N.near_duplicates(df, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, k)


def test_null_and_repeated_keys(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(7, text), (3, text), (3, text), (None, text), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (None, 4, 3, True), (9, 0, 9, True)], key=repr)
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_rows_of_one_key_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(3, a), (3, b), (1, a + " o"), (2, b + " r"), (2, b + " r")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in N.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (3, 1), (3, 2)]


def test_sketch_merges_and_estimates():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)
    own = lambda *n: np.repeat(np.arange(len(n)), n)
    u, v, both = S.sketch(np.concatenate([a, a[:2000], b, a, b]), own(3000, 3000, 4000), 3)
    assert (S.sketch(np.concatenate([a, a[:2000], b]), own(5000 + 1000), 1)[0] == both).all()
    assert (np.maximum(u, v) == both).all()
    seen = np.array([(u > v).sum()]), np.array([(u < v).sum()]), np.array([3000]), np.array([3000])
    assert abs(S.estimate(*seen)[0] - 0.5) < 0.12 and not S.plausible(*seen, 0.8)[0] and S.plausible(*seen, 0.5)[0]
    assert (S.equal(u, np.stack([u, v, both])) == [(u == x).sum() for x in (u, v, both)]).all()


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(5, 5), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
