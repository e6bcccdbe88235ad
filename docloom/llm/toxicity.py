"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, and scores of each hit's context.

``learn`` takes at most ``SAMPLE`` labelled rows (those with the smallest hash of their id; a fixed number however large the
table) and derives the lexicon from word and stem counts in them: entries commoner in toxic texts than chance allows (by a
likelihood-ratio test), the most telling of nested ones. A stem entry matches any word that begins with it. An entry's
weight is the logarithm of its odds, so a word that is never innocent counts more than a stem that often is. A word of a text is looked up by running the Levenshtein automaton of
the word over the trie, which finds entries of ``FROM`` letters or more at distance ``DISTANCE`` at most; it is run for words that
share half of an entry only, as a single edit leaves the other half whole. Words that the sample's other texts have as their
own are no misspellings: those near an entry are kept as exceptions.

A hit's weight depends on its context window: inside quotation marks, or next to words of reporting, it counts less;
next to other hits it counts more. A logistic model over a text's summed weights gives the score.

Scoring is one pass over the texts without a shuffle; the model (a lexicon of words of a sample of ``SAMPLE`` rows) is broadcast.

Defined cases: null, empty and wordless texts get the model's score for a text without hits; without any labelled row of
both classes every score is 0; null labels are ignored; if an id has several labels each counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erfc, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import stored

SAMPLE = 20_000
ODDS = 2.0  # the logarithm of how much commoner it must be there
CHANCE = 12.3  # and its likelihood ratio (G): beyond chance at one in 2000; four toxic texts of one in nine and no other have 17
FALSE = 0.05  # of the entries that may be chance, as so many are tested
STEM = (3, 4, 5, 6, 7, 8)
DISTANCE, FROM = 1, 5
WINDOW = 8
CACHE = 200_000
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile('["“”„«»]')
#: words of reporting in the four languages of the tables
REPORTING = frozenset("said says wrote quoted called quote dit cite selon sagte schrieb zitat dijo cita llamó".split())


class Levenshtein:
    """The automaton of a word: states are rows of (place, edits) with at most k edits."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple, letter: str) -> tuple:
        best: dict[int, int] = {}
        for i, e in state:
            for place, edits in ((i, e + 1), (i + 1, e + (i >= len(self.word) or self.word[i] != letter))):
                if place <= len(self.word) and edits <= self.k and edits < best.get(place, self.k + 1):
                    best[place] = edits
        for i in sorted(best):  # letters of the word left out
            j, e = i + 1, best[i] + 1
            while j <= len(self.word) and e <= self.k and e < best.get(j, self.k + 1):
                best[j] = e
                j, e = j + 1, e + 1
        return tuple(sorted(best.items()))

    def accepts(self, state: tuple) -> int | None:
        return next((e for i, e in state if i == len(self.word)), None)

    def nearest(self, state: tuple) -> int | None:
        """The fewest edits by which the letters so far match a beginning of the word."""
        return min((e for i, e in state if i > 0), default=None)


def _one_edit(word: str, entry: str, stem: bool) -> bool:
    """Whether one edit at most makes the entry of the word (of its beginning, for a stem): what follows the first difference has to agree."""
    n, p = len(entry), 0
    if not stem and abs(len(word) - n) > 1:
        return False
    for x, y in zip(word, entry, strict=False):
        if x != y:
            break
        p += 1
    if p == n:
        return stem or len(word) <= n + 1
    for skip_word, skip_entry in ((1, 1), (1, 0), (0, 1)):
        rest = entry[p + skip_entry :]
        if word.startswith(rest, p + skip_word) and (stem or len(word) == p + skip_word + len(rest)):
            return True
    return False


class Lexicon:
    """A trie of entries with weights; a stem entry matches words that begin with it. Exceptions match nothing but themselves as entries."""

    def __init__(self, words: list[str], stems: list[str], weights: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset()):
        self.trie: dict = {}
        self.exceptions, weights = exceptions, weights or {}
        for entry, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = self.trie
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = (node[""][0] or stem if "" in node else stem, weights.get(entry, 1.0))
        # an edit leaves one half of an entry whole: the first at its place, the second at most one place off
        self.heads: dict[int, dict[str, list[tuple[str, bool]]]] = {}
        self.tails: dict[tuple[int, int], dict[str, list[tuple[str, bool]]]] = {}
        for e, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            if len(e) >= FROM:
                half = len(e) // 2
                self.heads.setdefault(half, {}).setdefault(e[:half], []).append((e, stem))
                for place in range(half - DISTANCE, half + DISTANCE + 1):
                    self.tails.setdefault((place, place + len(e) - half), {}).setdefault(e[half:], []).append((e, stem))

    def _may(self, word: str) -> bool:
        """Whether the automaton can find an entry: one that shares a half with the word is an edit away in its other half as well."""
        fits = lambda found: any(_one_edit(word, e, stem) for e, stem in found)
        for n, heads in self.heads.items():
            if (found := heads.get(word[:n])) and fits(found):
                return True
        for (a, b), tails in self.tails.items():
            if (found := tails.get(word[a:b])) and fits(found):
                return True
        return False

    def exact(self, word: str) -> float:
        """The weight of the entry that the word is, or of the longest stem it begins with; 0 without one."""
        node, found = self.trie, 0.0
        for c in word:
            if "" in node and node[""][0]:
                found = node[""][1]
            node = node.get(c)
            if node is None:
                return found
        return node[""][1] if "" in node else found

    def near(self, word: str) -> float:
        """The largest weight of entries of FROM letters or more within DISTANCE of the word (of its beginning, for a stem)."""
        if len(word) < FROM - DISTANCE or word in self.exceptions or not self._may(word):
            return 0.0
        automaton = Levenshtein(word, DISTANCE)
        stack, found = [(self.trie, automaton.start(), 0)], 0.0
        while stack:
            node, state, depth = stack.pop()
            if "" in node and depth >= FROM and (automaton.accepts(state) is not None or node[""][0] and automaton.nearest(state) is not None):
                found = max(found, node[""][1])
            for c, below in node.items():
                if c and (then := automaton.step(state, c)):
                    stack.append((below, then, depth + 1))
        return found

    def __call__(self, word: str) -> tuple[int, float]:
        """(2 exact, 1 misspelled, 0 no entry; weight)."""
        if weight := self.exact(word):
            return 2, weight
        return (1, weight) if (weight := self.near(word)) else (0, 0.0)


class Matcher(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.lexicon(word)
        return found


FEATURES = 6
NEAR = 0.7  # of a misspelled hit against an exact one; labelled texts correct it where there are any with misspellings
QUOTE = 400  # letters that a quotation may have


def quotations(text: str) -> tuple[list[int], list[int]]:
    """(starts, ends) of stretches between a mark and the next one, within a paragraph and ``QUOTE`` letters; a stray mark opens nothing."""
    starts, ends, opened = [], [], None
    for m in QUOTES.finditer(text):
        at = m.start()
        if opened is not None and at - opened <= QUOTE and "\n\n" not in text[opened:at]:
            starts.append(opened)
            ends.append(at)
            opened = None
        else:
            opened = at
    return starts, ends


def features(text: str | None, match: Matcher) -> list[float]:
    """Summed context weights of all hits, as they are and by the text's length, whether there are any, the part of misspelled and of quoted ones, and the most company that a hit has."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = [(i, m, w) for i, (m, w) in enumerate(map(match.__getitem__, words)) if m]
    if not found:
        return [0.0] * FEATURES
    wanted = iter([i for i, _, _ in found])
    places, next_ = [], next(wanted)
    for i, m in enumerate(WORD.finditer(low)):
        if i == next_:
            places.append(m.start())
            next_ = next(wanted, -1)
    starts, ends = quotations(low)
    total = near = quoted = most = 0.0
    for n, (i, m, w) in enumerate(found):
        at = bisect_right(starts, places[n]) - 1
        inside = at >= 0 and places[n] < ends[at]
        told = any(x in REPORTING for x in words[max(0, i - WINDOW) : i + WINDOW + 1])
        company = sum(abs(j - i) <= WINDOW for j, _, _ in found[max(0, n - WINDOW) : n + WINDOW + 1]) - 1
        weight = w * (0.4 if inside or told else 1.0) * (NEAR if m == 1 else 1.0) * (1 + 0.25 * company)
        total, near, quoted, most = total + weight, near + weight * (m == 1), quoted + (inside or told), max(most, company)
    return [float(np.log1p(total)), float(np.log1p(100 * total / len(words))), 1.0, float(np.log1p(near)), float(np.log1p(quoted)), float(np.log1p(most))]


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    entries: dict[str, float]  # their weights
    exceptions: frozenset[str]
    weights: np.ndarray  # of the features, then the constant; None: no model

    def matcher(self) -> Matcher:
        return Matcher(Lexicon(self.words, self.stems, self.entries, self.exceptions))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    return w


def _counts(sample: DataFrame) -> DataFrame:
    """(entry, stem, toxic, clean): in how many toxic and other texts of the sample a word or stem occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                stems = {w[:n] for w in words for n in STEM if len(w) >= n}
                for key in [*((w, False) for w in words), *((s, True) for s in stems)]:
                    total.setdefault(key, [0, 0])[0 if label else 1] += 1
        rows = [(e, s, t, c) for (e, s), (t, c) in total.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["entry", "stem", "toxic", "clean"])

    rows = sample.select("text", "label").mapInArrow(count, "entry string, stem boolean, toxic bigint, clean bigint")
    return rows.groupBy("entry", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beyond_chance(found: list, tested: int, false: float = FALSE) -> list:
    """Of the entries found among many tested ones, those of which a share of ``false`` at most is expected to be chance (Benjamini and Hochberg)."""
    chance = sorted((erfc((r["ratio"] / 2) ** 0.5), r["ratio"]) for r in found)  # of a chi-square variable with one degree of freedom
    least = min((g for i, (p, g) in enumerate(chance, 1) if p <= false * i / tested), default=float("inf"))
    return [r for r in found if r["ratio"] >= least]


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """labels: rows to learn from (id and label)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    # SAMPLE ids at most: the texts aren't shuffled for them
    rows = stored(docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id").select("text", "label"), "labelled")
    # copies of a text would make all of its words look like terms
    rows = stored(rows.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.max("label").alias("label"), F.any_value("text").alias("text")).select("text", "label"), "distinct")
    size = {r["label"]: r["n"] for r in rows.groupBy(F.when(F.col("label") != 0, 1).otherwise(0).alias("label")).agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (size[0] + 1.0))
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    all_, n1, n0 = size[0] + size[1], float(size[1]), float(size[0])
    has, without = t + c, F.lit(float(all_)) - t - c
    ratio = 2 * (share(t, has * n1 / all_) + share(c, has * n0 / all_) + share(n1 - t, without * n1 / all_) + share(n0 - c, without * n0 / all_))
    counts = stored(_counts(rows).withColumn("odds", odds), "entries")
    least = ceil(CHANCE / (2 * log(all_ / n1)))  # fewer toxic texts can't be beyond chance, whatever the rest
    found = counts.where((F.col("toxic") >= least) & (F.col("odds") >= ODDS)).withColumn("ratio", ratio).where(F.col("ratio") >= CHANCE).collect()
    found = _beyond_chance(found, counts.where(F.col("toxic") + F.col("clean") >= least).count())
    chosen: dict[tuple[str, bool], float] = {}
    taken: set[str] = set()  # chosen stems, and all beginnings of chosen entries: of nested entries the most telling one stays
    begun: set[str] = set()
    for r in sorted(found, key=lambda r: (-r["ratio"], r["stem"], -len(r["entry"]), r["entry"])):
        entry = r["entry"]
        if any(entry[:n] in taken for n in range(1, len(entry) + 1)) or (r["stem"] and entry in begun):
            continue
        chosen[entry, r["stem"]] = r["odds"]
        begun.update(entry[:n] for n in range(1, len(entry) + 1))
        if r["stem"]:
            taken.add(entry)
    words, stems = sorted(w for w, stem in chosen if not stem), sorted(w for w, stem in chosen if stem)
    entries = {w: o for (w, _), o in chosen.items()}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, stems, entries))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if not lexicon.exact(w) and lexicon.near(w)], pa.string())], ["entry"])

    innocent = counts.where((F.col("clean") >= least) & (F.col("odds") < ODDS) & ~F.col("stem")).select("entry").mapInArrow(own, "entry string")
    exceptions = frozenset(r["entry"] for r in innocent.collect())  # words of the sample that are one edit from an entry
    shared_model = spark.sparkContext.broadcast(Model(words, stems, entries, exceptions, np.zeros(FEATURES + 1)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared_model.value.matcher()
        for batch in batches:
            x = [features(t, match) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = rows.mapInArrow(vectors, "x array<double>, label int").groupBy("x", F.when(F.col("label") != 0, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    x = np.repeat(np.array([r["x"] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["y"] for r in got], float), [r["n"] for r in got])
    return Model(words, stems, entries, exceptions, regression(x, y))


def score(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        match = model.matcher() if model else None
        for batch in batches:
            texts = batch.column(1)
            x = np.array([features(t.as_py(), match) for t in texts]).reshape(-1, FEATURES) if model else None
            scores = model.score(x) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")
