import random
import time

from docloom.llm import urls
from docloom.llm.queries import RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        m = min([rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0], default=len(rest))
        path = rest[n:m]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def cases():
    r = random.Random(1)
    bits = ["http", "://", "a.", "EXAMPLE.", "example.", "com", "net", "org", "/", "en/", "de/", "es/", "7", "8", "?", "#", "x", ".", ":80", "É", "\n"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(1500)]
    made += [f"https://{h}{p}" for h in ("com", "a.example.com", "xexample.com", "net", "b.net", "example.net", "org", "", "com.", ".com") for p in ("", "/", "/en", "/en/", "/en/7", "/en/77/x", "/de/8?q", "/de/", "/es/#/en/", "//en/")]
    return [*made, None, "", "http://", "x" * 50_000, "http://" + "a." * 5000 + "com/en/" + "s/" * 5000]


def test_both_ways_match_brute_force(spark):
    made = cases()
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(made)], "page_id long, url string, label string")
    more = [*RULES, ("com", "/en/7/x", "block"), ("a.com", "/e", "allow"), ("com", "", "allow"), ("com", "/en/", "allow")]
    for rules in (RULES, more, []):
        for how in ({}, {"nodes": -1}):
            got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.filter_urls(df, rules, **how).collect()}
            assert got == {i: brute(u, rules) for i, u in enumerate(made)}, (rules, how)
    assert urls.filter_urls(df.limit(0), RULES).collect() == []


def test_rules_as_a_table_and_clashing_columns(spark):
    rules = [*RULES, ("com", "/en/", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "mine", "h", "p", 1) for i, u in enumerate(cases()[-80:])], "page_id long, url string, rule string, host string, path string, verdict int")
    want = {i: brute(u, rules) for i, u in enumerate(cases()[-80:])}
    for given, nodes in ((table, 1000), (table, 3), (rules, 1000)):
        got = urls.filter_urls(df, given, nodes=nodes)
        assert sorted(got.columns) == sorted(["page_id", "url", "host", "path", "rule", "verdict"])
        assert {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in got.collect()} == want


def test_many_entries_under_one_node_are_looked_up():
    trie = urls.Trie([("com", f"/{i:06d}", "block") for i in range(50_000)])
    began = time.time()
    assert sum(trie.find("a.com", f"/{i:06d}x/y") == (f"com/{i:06d}", "block") for i in range(0, 50_000, 5)) == 10_000
    assert time.time() - began < 2 and len(trie.edges) == 2
