"""Toxicity: a lexicon trie met by Levenshtein automata, with context windows.

The lexicon is learned from labelled training rows: words, and word stems, that toxic documents hold and others
don't. Its trie is intersected with Levenshtein automata of distance one; the product is determinised as words are
read and shared by all words of a worker, so a word costs a few steps of a table and most end after some letters.
Misspelled terms of five letters and more are found so. Around each hit a window of words tells quotation (quote
marks, words of saying) from abuse (words of address, repeated hits, exclamation). Counts by kind of hit and context
are the features of a logistic regression, trained on the same rows.

Labels are read only from rows whose crc32 of the id as text leaves a remainder other than 0 by 5. At most
``SAMPLE`` labelled rows of each class, those with the smallest hashes of their ids, are fitted (a documented bound:
the lexicon and weights stay small and don't grow with the data); every document is scored. Text is the only input.

Scale: labels are a bounded sample by id, found by one top-k; its ids filter the scan of documents as a broadcast of
at most 2 * SAMPLE numbers. Features are counted exactly, so the model doesn't depend on how rows are dealt; what that
shuffles is bounded by the sample's words. Scoring is one pass in Arrow batches without a shuffle. The lexicon has at
most ``TERMS`` entries.

Defined results: a null or empty text has no hits and gets the lowest score; an id with labels of both classes is left
out of the training, one with several documents trains with one of them (the smallest hash of its texts); without any labels the lexicon is
empty and all documents get score 0; repeated rows are scored one by one; rows without an id are not held out
(crc32 of null is null) and never train; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_text, carried, cut, read_table, restored

FOLDS = 5
#: Labelled rows of a class that are fitted at most, and entries of the lexicon at most.
SAMPLE = 6000
TERMS = 400
STEMS = range(4, 10)
FUZZY_LETTERS = 5
#: How common a term may be in other documents, as a share of how common it is in toxic ones.
IMPURE = 0.06
WINDOW = 6
#: Distinct words that a worker remembers before it forgets them all.
MEMO = 500_000
#: Fixed cue words for the context.
SAYING = frozenset("said says say quote quoted quotes called calls wrote writes term word words according reported claimed".split())
ADDRESS = frozenset("you your yours you're u ur du dein deine ihr tu toi vous usted ustedes".split())
_STRIP = ".,;:!?\"'()[]{}<>#$%&*|=+~_-“”«»„‘’…¡¿"
_QUOTES = frozenset("\"“”«»„‘’")
_WORD = re.compile(r"\S+")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def normal(word: str) -> str:
    return word.strip(_STRIP)


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool
    odds: float  # log of how much commoner it is in toxic documents


class Automaton:
    """The product of the lexicon's trie with Levenshtein automata of distance one, determinised lazily.

    A state is a set of (trie node, edits spent, may close): the usual nondeterministic automaton's positions, with
    the trie's nodes for places in a word. ``kind`` is 0 none, 1 exact word, 2 exact stem, 3 misspelled word,
    4 misspelled stem; the lowest that applies."""

    def __init__(self, entries: list[Entry]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.fuzzy: list[bool] = [False]
        self.odds: list[float] = [0.0]
        for e in entries:
            at = 0
            for ch in e.text:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.word.append(False)
                    self.stem.append(False)
                    self.fuzzy.append(False)
                    self.odds.append(0.0)
                at = self.next[at][ch]
            (self.stem if e.stem else self.word)[at] = True
            self.fuzzy[at] = len(e.text) >= FUZZY_LETTERS
            self.odds[at] = e.odds
        self.ids: dict[frozenset[tuple[int, int]], int] = {}
        self.states: list[frozenset[tuple[int, int]]] = []
        self.step: list[dict[str, int]] = []
        self.hit: list[tuple[tuple[int, float], tuple[int, float]]] = []
        self.start = self._state({(0, 0)})
        self.memo: dict[str, tuple[int, float]] = {}

    def _state(self, raw: set[tuple[int, int]]) -> int:
        # A letter of the term may be missing from the word: spend the edit without reading.
        full = set(raw)
        for node, spent in raw:
            if spent == 0:
                full |= {(child, 1) for child in self.next[node].values()}
        key = frozenset(x for x in full if x[1] == 0 or (x[0], 0) not in full)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            word = max(((-1 - 2 * s, self.odds[n]) for n, s in key if self.word[n] and (s == 0 or self.fuzzy[n])), default=(-9, 0.0))
            stem = max(((-2 - 2 * s, self.odds[n]) for n, s in key if self.stem[n] and (s == 0 or self.fuzzy[n])), default=(-9, 0.0))
            self.hit.append((word, stem))
        return self.ids[key]

    def _advance(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, spent in self.states[state]:
            child = self.next[node].get(ch)
            if child is not None:
                out.add((child, spent))
            if spent == 0:
                out.add((node, 1))  # an extra letter in the word
                out |= {(c, 1) for c in self.next[node].values()}  # another letter
        to = self.step[state][ch] = self._state(out) if out else -1
        return to

    def kind(self, word: str) -> tuple[int, float]:
        """(kind, log odds of the term); (0, 0) for most words."""
        known = self.memo.get(word)
        if known is not None:
            return known
        state, best = self.start, (-9, 0.0)
        for ch in word:
            to = self.step[state].get(ch)
            state = self._advance(state, ch) if to is None else to
            if state < 0:
                break
            best = max(best, self.hit[state][1])
        if state >= 0:
            best = max(best, self.hit[state][0])
        if len(self.memo) >= MEMO:
            self.memo.clear()
        out = self.memo[word] = (-best[0], best[1]) if best[0] > -9 else (0, 0.0)
        return out


FEATURES = 9


def features(text: str, auto: Automaton) -> list[float]:
    """Counts by kind of hit, of quoted and abusive contexts, their rate."""
    if not text:
        return [0.0] * FEATURES
    low = text.lower()
    kinds = {w: k for w in set(low.split()) if (k := auto.kind(w.strip(_STRIP)))[0]}
    out = [0.0] * FEATURES
    if not kinds:
        return out
    words = low.split()
    hits = [i for i, w in enumerate(words) if w in kinds]
    for i in hits:
        k = kinds[words[i]][0]
        out[k - 1] += 1
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        marks = sum(not _QUOTES.isdisjoint(w) for w in near)
        quoted = marks >= 2 or any(w.strip(_STRIP) in SAYING for w in near)
        abusive = any(w.strip(_STRIP) in ADDRESS for w in near) or "!" in words[i] or sum(w in kinds for w in near) > 1
        if quoted:
            out[4] += 1
        if k <= 2 and not quoted:
            out[5] += 1
        if abusive and not quoted:
            out[6] += 1
    out[7] = 100.0 * sum(out[:2]) / len(words)
    out[8] = sum(odds for k, odds in kinds.values() if k <= 2)
    return [math.log1p(x) for x in out]


def _presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold a word ("=...") or a stem, by task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for t, y in zip(b["t"], b["y"], strict=True):
            words = {normal(w) for w in set(as_text(t).lower().split())}
            found = {f"={w}" for w in words if 3 <= len(w) <= 24} | {w[:n] for w in words for n in STEMS if len(w) >= n}
            counts[int(y)].update(found)
    # Every count is handed on: another task's toxic rows may hold a feature that is met once here.
    keys = list(counts[1] | counts[0])
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        yield pd.DataFrame({"f": part, "p": [counts[1][k] for k in part], "q": [counts[0][k] for k in part]})


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, other: int) -> list[Entry]:
    """Lexicon from (feature, toxic documents, other documents): pure features, the longest stem that keeps nearly
    all of a shorter one's documents, no entry under a stem that is in already."""
    odds = {f: min(6.0, math.log((p + 0.5) / (toxic + 1) / ((q + 0.5) / (other + 1)))) for f, p, q in rows}
    good = {f: p for f, p, q in rows if p >= max(4, 0.004 * toxic) and q / max(1, other) <= IMPURE * p / max(1, toxic)}
    stems = {f: p for f, p in good.items() if f[0] != "="}
    out: dict[str, Entry] = {}
    for f, p in sorted(stems.items(), key=lambda x: (len(x[0]), x[0])):
        if any(f[:n] in out for n in range(1, len(f))):
            continue
        best = f
        while True:
            longer = [g for g in stems if len(g) == len(best) + 1 and g.startswith(best) and stems[g] >= 0.95 * p]
            if not longer:
                break
            best = max(longer, key=lambda g: (stems[g], g))
        word = next((w for w in good if w[0] == "=" and w[1:].startswith(best) and good[w] >= 0.95 * p), None)
        out[f] = Entry(word[1:], False, odds[word]) if word else Entry(best, True, odds[best])
    stems_in = {e.text for e in out.values() if e.stem} | {f for f, e in out.items() if not e.stem and len(f) >= 4}
    for f in good:
        if f[0] == "=" and not any(f[1 : 1 + n] in stems_in for n in range(1, len(f))):
            out[f] = Entry(f[1:], False, odds[f])
    rank = {e: max(good.get("=" + e.text, 0), good.get(e.text, 0)) for e in out.values()}
    return sorted(rank, key=lambda e: (-rank[e], e.text, e.stem))[:TERMS]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 1.0, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient descent from zero; classes weigh alike. The last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    s = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(a @ w, -30, 30))) - y) * s
        g = a.T @ e + l2 * np.append(w[:-1], 0)
        w -= rate * 4 * g
    return w


@dataclass(frozen=True)
class Model:
    entries: tuple[Entry, ...]
    weights: tuple[float, ...]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    lab = labels.select(labels[id_col].alias("k"), labels[label_col].alias("y"))
    lab = lab.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    lab = lab.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    chosen = [r for y in (0, 1) for r in lab.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(7), "k"), "k").limit(sample).collect()]
    if not any(r.y for r in chosen) or all(r.y for r in chosen):
        return Model((), (0.0,) * FEATURES + (-30.0,))
    kind = labels.schema[id_col].dataType.simpleString()
    few = spark.createDataFrame([(r.k, int(r.y)) for r in chosen], f"k {kind}, y int")
    found = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t")).join(F.broadcast(few), "k")
    # One text for each id, however often the id is repeated.
    one = found.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t"), "t")).alias("x"))
    rows = cut(one.select("x.t", "y"))
    toxic, other = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not toxic or not other:
        return Model((), (0.0,) * FEATURES + (-30.0,))
    counts = rows.mapInPandas(_presence, "f string, p long, q long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    pure = counts.where((F.col("p") >= F.greatest(F.lit(4.0), F.lit(0.004 * toxic))) & (F.col("q") / other <= IMPURE * F.col("p") / toxic))
    entries = choose_entries([tuple(r) for r in pure.orderBy(F.desc("p"), "f").limit(40 * TERMS).collect()], toxic, other)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = Automaton(entries)
        for b in batches:
            yield pd.DataFrame({"x": [features(as_text(t), auto) for t in b["t"]], "y": b["y"]})

    got = rows.mapInPandas(measure, "x array<double>, y int").collect()  # 2 * sample rows of FEATURES numbers at most
    data = sorted((tuple(r.x), r.y) for r in got)
    w = fit(np.array([x for x, _ in data]), np.array([y for _, y in data]))
    return Model(tuple(entries), tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, w = Automaton(list(model.entries)), np.array(model.weights)
        for b in batches:
            x = np.array([features(as_text(t), auto) for t in b["t"]]).reshape(len(b), FEATURES)
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pd.DataFrame({"i": b["i"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    flat = docs.select(carried(docs, id_col), docs[text_col].alias("t"))
    out = restored(flat.mapInPandas(run, "i string, score double, predicted int"), docs, id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, read_table(spark, sf_dir, "labels")))
