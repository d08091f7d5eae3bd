"""Each stage of the pipeline on nulls, empty and very long texts, ties, repeated rows and an empty table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DOC int, kept string"


def body(i):
    return " ".join(f"w{i}x{k}" for k in range(70))


def rows():
    long = " ".join(f"v{k}" for k in range(60_000))
    out = [(i, body(i), "en", "a", len(body(i))) for i in range(20)]
    out += [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, body(90), "en", None, 3), (None, body(90), "en", None, 3)]
    out += [(40, long, "de", "b", len(long)), (41, long + " end", "de", "b", 1), (42, "n" * 400_000, "de", "b", 1)]
    out += [(5, body(5), "en", "a", len(body(5)))] * 3 + [(5, body(95), "en", "b", None)]
    out += [(60, body(3), "fr", "c", 9), (61, body(4) + " mail a@b.cc", None, "c", 9), (9_007_199_254_740_993, body(99), "en", "a", 1)]
    return [(*r, k, None) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def triples(frame):
    return sorted(map(str, ((r.doc_id, r.text, r.source) for r in frame)))


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, odd, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), "").count() == 0


def test_quality_stage(spark, odd):
    got = corpus_pipeline.quality_rules(spark, odd, "").collect()
    kept = [r for r in quality.judge(odd).where("kept").collect()]
    assert Counter(str(r.doc_id) for r in got) == Counter(str(r.doc_id) for r in kept) and len(got) > 20


@pytest.mark.parametrize("bound", [corpus_pipeline.BROADCAST_ROWS, 0])
def test_jaccard_stage(spark, odd, bound, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", bound)
    got = triples(corpus_pipeline.one_of_each_group(spark, odd, "").collect())
    alive = [r for r in rows() if not (r[0] == 60 or r[0] == 61 or r[0] == 41)]
    assert got == sorted({str((r[0], r[1], r[3])) for r in alive})


def test_personal_data_stage(spark, odd):
    got = corpus_pipeline.personal_data(spark, odd, "").collect()
    assert len(got) == len(rows()) and all(r.text is None or (r.n_chars == len(r.text) and not pii.base_spans(r.text)) for r in got)
    assert sum(r.text is None for r in got) == 1 and any(r.text and r.text.endswith("mail [email]") for r in got)


def test_mixing_stage(spark, odd):
    got = corpus_pipeline.mixed(spark, odd, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    words = Counter()
    for r in got.collect():
        words[str(r.doc_id)] += len(r.text.split())
    taken = Counter()
    for r in mixing.mix(odd.select(*corpus_pipeline.COLUMNS)).collect():
        taken[str(r.doc_id)] += r.taken
    assert +words == +taken


def test_codec_stage(spark, odd):
    got = corpus_pipeline.tokens(spark, odd, "").select("doc_id", "n_tokens", F.size("ids").alias("n")).collect()
    assert len(got) == len(rows()) and all(r.n == r.n_tokens for r in got)
