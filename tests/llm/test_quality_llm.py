"""Line frequency: the verdict against DuckDB where it fires, copies that count once, both ways to clean, the sketch."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry.llm import imatch, quality, sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def unique(i, n=60):
    return " ".join(f"u{i}x{k}" for k in range(n))


def rows():
    """Boilerplate in documents with own text, depleted documents, a group of near copies, a boilerplate document."""
    foot, body = "All  rights reserved", " ".join(f"c{k}" for k in range(70))
    out = [(unique(i) + "\n" + foot, "a") for i in range(40)]
    out += [(unique(100 + i) + "\n" + body, "b") for i in range(30)]
    lines = [" ".join(f"l{k}w{j}" for j in range(12)) for k in range(10)]
    for i in range(300):
        mine = list(lines)
        mine[i % 10] = mine[i % 10].replace("w5", f"w5y{i}")
        out.append(("\n".join(mine), "c"))
    out += [(unique(1000 + i) + "\n" + lines[0], "d") for i in range(25)] + [("\n".join(lines[:1] * 3 + lines[:1] * 3), "d")]
    out += [(unique(5), None), (None, "a"), ("", "a"), (out[0][0], "a"), (body, "b")]
    return [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def test_verdicts_equal_sql_where_lines_are_common(docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text", "lang", "source", "n_chars"]))
    df = quality.verdicts(docs)
    cur = con.execute(quality.SQL)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
    got = {r[0]: r[-1] for r in want}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(40, 70))  # footer; depleted by the method
    assert all(got[i] for i in range(70, 370))  # near copies aren't rejected
    assert sum(r[-2] for r in want) >= 71


@pytest.mark.parametrize("keys", [quality.COMMON_KEYS, 0])
def test_both_ways_to_clean(docs, keys):
    kept = {r.doc_id: r.removed_words for r in quality.verdicts(docs).collect() if r.kept}
    got = {r.doc_id: r.text for r in quality.cleaned(docs, common_keys=keys).collect()}
    assert got.keys() == kept.keys()
    for i, t, *_ in rows():
        if i in got:
            assert len(got[i].split()) == len(t.split()) - kept[i]
            assert set(got[i].split("\n")) <= set(t.split("\n"))


def test_a_line_of_a_large_host_is_common():
    assert quality.MOST_TEXTS < 0.02 * 60_000


def test_large_host_limit(spark):
    big = [(i, f"{unique(i, 3)}\nshared footer line", "h") for i in range(60)] + [(100 + i, unique(i, 4), "h") for i in range(400)]
    df = spark.createDataFrame(big, "doc_id long, text string, source string")
    count = lambda most: quality.judge(df, min_texts=2, share=0.5, most_texts=most).where("n_removed_lines > 0").count()
    assert count(50) == 60 and count(1000) == 0


def test_sketch_counts_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(130)
    n, counts = sketch.collected(sketch.frequencies(df, "t", imatch.term_sets))
    want = np.zeros(1 << sketch.BITS, dtype=np.uint64)
    for x in imatch.term_sets(texts):
        np.add.at(want, sketch.slots(x), 1)
    assert n == 400 and (counts == want).all()
    assert sketch.collected(sketch.frequencies(df.limit(0), "t", imatch.term_sets))[0] == 0


def test_chance_is_taken_off(spark):
    """Texts of many rare terms fill every counter; only terms over the band's lower edge are in the lexicon."""
    rng = random.Random(4)
    texts = [" ".join(["often"] * (i % 10 == 0) + [f"r{rng.random()}" for _ in range(3000)]) for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    bits = np.unpackbits(np.frombuffer(imatch.lexicon(df, band=(1 / 200, 1 / 5)), dtype=np.uint8))
    assert bits[sketch.slots(imatch.term_sets(["often"])[0])].all() and bits.sum() < 50
