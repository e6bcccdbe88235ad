"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence of allow and block entries.

An entry is a host and a path prefix. It fits its host and all hosts below it, where the url's path starts with the
entry's. The trie's edges are host labels from the right, then whole path segments; an entry's last segment is a prefix
of the url's segment there. Of the entries that fit, the longest (host and path together) decides, of equals the one
with the longer host, then block. Urls that no entry fits get the default verdict.

The trie is broadcast while its entries have ``NODES`` labels and segments at most (counted before it is built); a longer
list is joined on host suffixes instead, in a shuffle join of (row, suffix) with entries by host, and the longest match
is taken by a partial aggregation.

Defined cases: a null url, or one without "://", has empty host and path; empty labels and ports are compared as they
stand; entries may repeat. Input columns are kept; host, path, rule and verdict are added, and replace columns of these names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = 300_000  # of a broadcast trie: some 100 MB in each Python worker
Rule = tuple[str, str, str]  # host, path, verdict


class Trie:
    """Edges in one table: (node, label) of hosts and (node, "/" and segment) of paths lead to a node's number."""

    def __init__(self, rules: list[Rule]):
        self.edges: dict[tuple[int, str], int] = {}
        #: node -> prefixes of the next segment and their best ranked entries, and the lengths that such prefixes have
        self.ends: dict[int, dict[str, tuple]] = {}
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")):
                node = self._below(node, label)
            *whole, last = path.split("/")
            for segment in whole:
                node = self._below(node, "/" + segment)
            entry = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            here = self.ends.setdefault(node, {})
            here[last] = max(here.get(last, entry), entry)
        self.lengths = {node: sorted({len(p) for p in prefixes}) for node, prefixes in self.ends.items()}

    def _below(self, node: int, label: str) -> int:
        return self.edges.setdefault((node, label), len(self.edges) + 1)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node, segments = None, 0, path.split("/")
        for label in reversed(host.split(".")):
            node = self.edges.get((node, label))
            if node is None:
                break
            inner = node
            for segment in segments:
                for n in self.lengths.get(inner, ()):
                    if n > len(segment):
                        break
                    entry = self.ends[inner].get(segment[:n])
                    if entry and (best is None or entry > best):
                        best = entry
                inner = self.edges.get((inner, "/" + segment))
                if inner is None:
                    break
        return best and (best[3], best[4])


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (after the first "://", A-Z lower-cased) and path (without query and fragment)."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), "path": F.coalesce(path, F.lit(""))})


def filter_urls(df: DataFrame, rules: list[Rule] | DataFrame, *, url: str = "url", default: str = "allow", nodes: int = NODES) -> DataFrame:
    """df with host, path, rule (host and path of the entry that decides, else null) and verdict. rules: a list, or a table of host, path, verdict."""
    df = parts(df.drop(*({"rule", "verdict"} - {url})), url)
    if url in ("rule", "verdict"):
        df = df.drop(url)
    if isinstance(rules, DataFrame):
        few = rules.agg(F.sum(F.size(F.split("host", r"\.")) + F.size(F.split("path", "/"))).alias("n")).first()["n"] or 0
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()] if few <= nodes else rules
    else:
        few = sum(h.count(".") + p.count("/") + 2 for h, p, _ in rules)
    if few > nodes:
        return _joined(df, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    names = df.columns
    return df.withColumn("__judged", judged("host", "path")).select(*names, "__judged.rule", "__judged.verdict")


def _joined(df: DataFrame, rules: list[Rule] | DataFrame, default: str) -> DataFrame:
    spark, names = df.sparkSession, df.columns
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(dict.fromkeys(rules)), "host string, path string, verdict string")
    entries = rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("verdict").alias("__verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # distinct (host, path) pairs are matched once, whatever the number of rows that share them
    pairs = df.select("host", "path").distinct().withColumn("__host", F.explode(suffixes))
    fits = pairs.join(entries, "__host").where(F.col("path").startswith(F.col("__path")))
    rank = F.struct((F.length("__host") + F.length("__path")).alias("a"), F.length("__host").alias("b"), (F.col("__verdict") == "block").alias("c"), F.concat("__host", "__path").alias("rule"), F.col("__verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    return df.join(best, ["host", "path"], "left").select(*names, "__best.rule", F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
