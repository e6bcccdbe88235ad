import random
import time
import zlib

from docloom.llm import queries as Q
from docloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_lookup_matches_edit_distance():
    r = random.Random(1)
    words, stems = ["stupid", "abcab", "scum", "bcbcb"], ["caccab", "lowei"]
    lexicon = T.Lexicon(words, stems)
    for _ in range(4000):
        w = list(r.choice(words + [s + r.choice(["", "ab", "xyz"]) for s in stems]))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "b", "z"])
        w = "".join(w)
        exact = w in words or any(w.startswith(s) for s in stems)
        near = any(distance(w, e) <= 1 for e in words if len(e) >= 5) or any(distance(w[:n], s) <= 1 for s in stems for n in range(max(1, len(s) - 1), len(s) + 2) if n <= len(w))
        assert lexicon(w)[0] == (2 if exact else 1 if near else 0), w


def test_learns_and_scores(spark):
    r = random.Random(2)
    bad = ["idiot", "stupid", "pathetic", "scum"]
    say = lambda n: [r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n)]
    docs, labels = [], []
    for i in range(600):
        words, toxic = say(r.randint(0, 60)), i % 4 == 0
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words) + 1), r.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, "you idiott, so st0pid"), (1001, ""), (1002, None), (1003, "alpha beta"), (None, "idiot")]
    d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, label int").repartition(3)
    b = spark.createDataFrame([*labels, (1003, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in Q.toxic_scores(d, b).collect()}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in held)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == got[1003]["predicted"] == 0
    assert {r["score"] for r in Q.toxic_scores(d, b.limit(0)).collect()} == {0.0}
    assert Q.toxic_scores(d.limit(0), b).collect() == []


def test_quotation_counts_less():
    match = T.Matcher(T.Lexicon(["idiot"], []))
    plain, quoted, told = (T.features(t, match)[0] for t in ("you idiot there", 'the word "idiot" there', "he said idiot there"))
    assert quoted < plain and told < plain


def test_learns_many_rare_terms(spark):
    r = random.Random(3)
    terms = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(300)]
    texts = [["alpha", f"n{i}"] for i in range(2600)]
    for n, t in enumerate(terms):
        for i in range(5):
            texts[(n + 97 * i) % 600].append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    model = T.learn(docs, spark.createDataFrame([(i, int(i < 600)) for i in range(2600)], "doc_id long, toxic int"))
    lexicon = model.matcher().lexicon
    assert all(lexicon.exact(t) for t in terms)


def test_a_stray_mark_quotes_nothing():
    match = T.Matcher(T.Lexicon(["idiot"], []))
    plain, stray, far, closed = (T.features(t, match)[0] for t in ("you idiot there", 'say " you idiot there', '" ' + "x " * 300 + 'you idiot there "', '"a" you idiot "b"'))
    assert plain == stray == far == closed
    assert T.quotations('"a" b "c"') == ([0, 6], [2, 8]) and T.quotations('"a\n\nb" c"') == ([5], [8])


def test_a_very_long_text_and_weights():
    match = T.Matcher(T.Lexicon(["idiot", "damns"], ["scumm"], {"idiot": 7.0, "damns": 2.0, "scumm": 3.0}, frozenset({"idiom"})))
    assert [match[w] for w in ("idiot", "idi0t", "idiom", "scummy", "scumy", "damns")] == [(2, 7.0), (1, 7.0), (0, 0.0), (2, 3.0), (1, 3.0), (2, 2.0)]
    began = time.time()
    long = T.features("a clean word " * 400_000 + "idiot", match)
    assert long[2] == 1.0 and 0 < long[1] < T.features("you idiot", match)[1] and time.time() - began < 20
    assert T.features('idiot " ' * 20_000, match)[2] == 1.0 and time.time() - began < 40


def test_words_of_other_texts_are_no_misspellings(spark):
    r = random.Random(4)
    say = lambda: " ".join(r.choice(["alpha", "beta", "oron", "gamma"]) for _ in range(20))
    docs = [(i, say() + (" moron " if i % 5 == 0 else " ") + say()) for i in range(400)]
    model = T.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int"))
    match = model.matcher()
    assert match["oron"] == (0, 0.0) and match["morom"][0] == 1 and match["moron"][0] == 2


def test_held_out_recall(spark):
    """On the labelled rows of sf0.1 that nothing was learned from: nine of ten toxic texts, and no clean one in a hundred."""
    sf = "/root/testdata/sf0.1"
    got = Q.op7_levenshtein(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
