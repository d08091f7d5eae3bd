"""Toxicity: what is learned from odd labels and rows, and the score against a plain sum."""

from __future__ import annotations

import math

import pytest

from quarry.llm import toxicity

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, toxic int, text string"


def rows():
    return [(i, f"text{i} " + ("vile vermin you" if i % 3 == 0 else "plain words"), "en") for i in range(200)]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(spark.createDataFrame(rows(), DOCS), spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(200)], LABELS))


def test_odd_labels_and_documents_change_nothing(spark, model):
    """Null ids and labels, labels twice, ids without a document, documents twice, nulls and empty texts."""
    docs = [*rows(), *rows()[:50], (None, "vile vermin you", "en"), (1000, None, None), (1001, "", "en")]
    labels = [(i, int(i % 3 == 0), None) for i in range(200)] * 2 + [(None, 1, "x"), (5000, 1, "x"), (7, None, "x"), (8, 5, "x")]
    got = toxicity.learn(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(labels, LABELS))
    assert got == model and {e.text for e in model.entries} == {"vile", "vermin", "you"}


def test_contradictory_labels_are_left_out(spark, model):
    labels = [(i, int(i % 3 == 0), "x") for i in range(200)]
    both = [(i, 1 - int(i % 3 == 0), "x") for i in range(0, 30)]
    with_both = toxicity.learn(spark.createDataFrame(rows(), DOCS), spark.createDataFrame(labels + both, LABELS).repartition(5))
    without = toxicity.learn(spark.createDataFrame(rows(), DOCS), spark.createDataFrame(labels[30:], LABELS))
    assert with_both == without


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], LABELS)
    empty = toxicity.learn(docs, labels)
    assert empty.entries == () and {r.score < 1e-9 for r in toxicity.score(docs, empty).collect()} == {True}
    assert toxicity.learn(docs.limit(0), spark.createDataFrame([(1, 1, ""), (2, 0, "")], LABELS)).entries == ()


def test_scores_are_the_logistic_of_the_features(spark, model):
    docs = [*rows()[:9], (900, "she said the word \"vermin\" was used", "en"), (901, "vermen and vlie!", "en"), (902, None, "en"), (903, "a " * 50_000 + "vile", "en")]
    auto = toxicity.Automaton(list(model.entries))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, DOCS), model).collect()}
    for i, t, _ in docs:
        x = toxicity.features(t or "", auto)
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1])))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.5)
    assert got[0].predicted == 1 and got[1].predicted == 0 and got[902].predicted == 0
