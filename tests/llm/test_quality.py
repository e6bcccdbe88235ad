import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import quality as K
from docloom.llm import queries as Q
from docloom.session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    stats = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
    chars = max(stats[1], 1)
    x = [math.log(chars / max(1, len(words))), math.log(1 + 100 * stats[2] / chars), math.asin(math.sqrt(stats[3] / max(1, len(lines)))), math.asin(math.sqrt(stats[4] / max(1, len(words)))), math.log(1 + 10 * len(re.findall("[A-Z!|]", t)) / chars)]
    return (*stats, len(words) < 50 or 100 * len(hit) > 50 * len(words)), x


def estimate(x):
    """The concentration steps of one group, in numpy."""
    best = None
    grid = np.floor(x * K.GRID + 0.5)
    at = lambda q: np.sort(grid, axis=0)[max(0, math.ceil(q * len(x)) - 1)] / K.GRID
    floors = np.diag(np.square(K.FLOORS))
    starts = [(at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2) + floors), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)]
    for m, c in starts:
        for step in range(K.STEPS + 1):
            d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1)
            b = np.floor(np.log(np.maximum(d, 1e-9)) * K.BINS)
            if step < K.STEPS:
                values, n = np.unique(b, return_counts=True)
                inside = values[np.cumsum(n) - n < (len(x) + K.P + 1) / 2]
                part = x[np.isin(b, inside)]
                m, c = part.mean(axis=0), np.cov(part.T, bias=True) + floors
        values, n = np.unique(b, return_counts=True)
        scale = K.MEDIAN / math.exp((values[np.cumsum(n) >= len(x) / 2][0] + 0.5) / K.BINS)
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = (det, m, np.linalg.inv(c), scale)
    return best[1:]


def make():
    r = random.Random(5)
    docs = []
    for i in range(500):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "a", "a", f"s{i % 7}"])
        words = [r.choice(["alpha", "be", "gammas", "d", "eps", "Zeta"]) + str(r.randrange(40)) for _ in range(r.choice([0, 10, 60, 80, 200]))]
        if i % 25 == 0:
            words = [w + "#%" for w in words]
        if i % 40 == 1:
            words = words[:4] * (len(words) // 4)
        text = " ".join(w + (".\n" if r.random() < 0.1 else "") for w in words)
        docs.append((i, text + ("\nsame line\n" * 9 if i % 30 == 2 else ""), lang, source))
    return [*docs, (900, None, "en", "a"), (901, "", None, None), (902, " \n\t ", "en", "a"), (903, "w\n" * 4000, "en", "a"), (904, "é" * 60_000, "en", "a"), (None, docs[7][1], *docs[7][2:]), docs[9]]


def test_matches_brute_force(spark):
    docs = make()
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, lang string, source string, n string, g int").repartition(3)
    got = {}
    for row in Q.quality_rules(df).collect():
        got.setdefault(row["doc_id"], row)
    groups = defaultdict(list)
    facts = {}
    for key, text, lang, source in docs:
        b, x = base(text)
        facts[key] = (b, x, (("s", lang, source), ("l", lang), ("a",)))
        assert tuple(got[key])[1:7] == b, key
        if not b[-1]:
            for g in facts[key][2]:
                groups[g].append(x)
    fitted = {g: estimate(np.array(x)) for g, x in groups.items() if len(x) >= K.LEAST}
    rejected = 0
    for key, (b, x, mine) in facts.items():
        m, inverse, scale = fitted[next(g for g in mine if g in fitted)]
        d = float((np.array(x) - m) @ inverse @ (np.array(x) - m) * scale)
        assert math.isclose(got[key]["distance"], d, rel_tol=1e-6, abs_tol=1e-6), key
        if abs(d - K.CUTOFF) > 1e-6:
            assert got[key]["kept"] == (not b[-1] and d <= K.CUTOFF), key
        rejected += not got[key]["kept"] and not b[-1]
    assert rejected <= 60


def test_many_estimates_are_joined_with_salts(spark):
    docs = [d for d in make() for _ in range(3 if d[0] == 9 else 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    rows = stored(K.with_statistics(df), "statistics")
    plain = K.judge(rows, K.fit(rows))
    fitted = K.fit(rows, few=0)
    salted = K.judge(rows, fitted, few=0)
    value = lambda df: sorted((str(r["doc_id"]), r["kept"], round(r["distance"], 6)) for r in df.collect())
    assert value(plain) == value(salted)
    good = rows.select(F.lit("a").alias("g"), *K.X)
    plan = K._joined(good, fitted, "g", few=0).groupBy("g").agg(*K._moments())._jdf.queryExecution().toString()
    assert "__salt" in plan and "SortMergeJoin" in plan
    aggregates = plan.split("== Physical Plan ==")[1]
    assert aggregates.index("partial_count") > aggregates.index("HashAggregate"), "aggregated before the shuffle on the group"


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 7, "x")], "doc_id long, text string, lang string, source string, n_words long, x0 string")
    assert K.with_statistics(df).first()["n_words"] == 2


def test_small_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "a"), (2, "few words", None, None)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: (r["kept"], r["distance"]) for r in Q.quality_rules(df).collect()} == {1: (True, None), 2: (False, None)}
    assert Q.quality_rules(df.limit(0)).collect() == []
