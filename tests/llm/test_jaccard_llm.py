"""The Jaccard join with lists in parts and chunks, hot keys, and words that a polynomial hash would mix up."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarry.llm import jaccard
from quarry.llm.common import shingle_sets, spread_join
from test_operators_llm import brute_components


def texts_of(seed):
    """Near copies of short and long texts, chains, a passage in many documents."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    out, passage = [], [word() for _ in range(30)]
    for n in (3, 6, 7, 8, 9, 11, 12, 20, 40, 120):
        base = [word() for _ in range(n)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            base = copy if rng.random() < 0.3 else base
    return out + [" ".join(passage + [word() for _ in range(rng.randint(3, 25))]) for _ in range(60)]


@pytest.mark.parametrize("held,chunk", [(jaccard.LIST, 9), (3, 16), (1, 64)])
def test_parts_and_chunks_change_nothing(spark, held, chunk):
    rows = list(enumerate(texts_of(held)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held=held, chunk=chunk).collect()}
    assert got == brute_components(rows)


def test_one_key_in_all_rows(spark):
    """All documents are copies or near copies of one text, or share most of its frequent shingles."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(400):
        copy = list(base)
        if i % 3:
            copy[rng.randrange(60)] = f"x{i}"
        if i % 10 == 0:
            copy = copy[:40] + [f"y{i}z{k}" for k in range(20)]
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), held=16, chunk=32).collect()}
    assert got == brute_components(rows)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("n", [16, 64, 1024, 4096])
def test_complementary_words_differ(n):
    t = thue_morse(n)
    c = t.translate(str.maketrans("ab", "ba"))
    a, b = shingle_sets([t.encode(), c.encode()])
    assert a != b
    one, two = shingle_sets([f"{t} {c} x y z".encode(), f"{c} {t} x y z".encode()])
    assert not np.array_equal(one, two)


def test_word_hashes_are_functions_of_words():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 200))) for _ in range(3000)}
    alone = {w: shingle_sets([w.encode()])[0][0] for w in words}
    assert len(set(alone.values())) == len(words)
    for a, b in zip(shingle_sets([w.encode() for w in words]), words, strict=True):
        assert a[0] == alone[b]


def test_spread_join(spark):
    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)], "k long, v long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as w")
    got = sorted(tuple(r) for r in spread_join(left, right, "k", "n", 120).select("k", "v", "w").collect())
    assert got == sorted((k % 3 if k < 90 else k, k, 2 * (k % 3 if k < 90 else k)) for k in range(120))
