"""The pipeline's stages one by one against plain versions, and the run as a whole."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from quarry.llm import bpe_codec, pii, quality
from test_operators_llm import brute_components


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, d)
        if name != "bpe_codec":
            assert out.columns == columns
        seen[name] = (before.collect(), out.cache().collect())
        before = out
    rows, kept = seen["quality_rules"]
    verdict = {r.doc_id: r.kept for r in quality.verdicts(docs).collect()}
    assert {r.doc_id for r in kept} == {i for i, k in verdict.items() if k} and len(kept) > 0.8 * len(rows)
    rows, kept = seen["ngram_jaccard_join"]
    want = brute_components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()})
    rows, masked = seen["personal_data"]
    assert len(rows) == len(masked) and not any(pii.base_spans(r.text) for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    clean = {r.doc_id: r.text for r in rows if not re.search(r"[0-9@]", r.text)}
    assert all(clean.get(r.doc_id, r.text) == r.text for r in masked)
    rows, mixed = seen["source_mixing"]
    times = Counter(r.doc_id for r in mixed)
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert all(words[r.doc_id] <= 2 * len(r.text.split()) for r in rows) and set(times) <= {r.doc_id for r in rows} and len(mixed) > len(rows)
    rows, coded = seen["bpe_codec"]
    assert len(rows) == len(coded) and {(r.doc_id, bpe_codec.decode(r.ids)) for r in coded} == {(r.doc_id, r.text.encode()) for r in rows}


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_quality_stage_takes_common_lines_out(spark):
    unique = lambda i: " ".join(f"u{i}x{k}" for k in range(60))
    rows = [(i, unique(i) + "\nall rights reserved", "en", "a", 7) for i in range(30)] + [(30, unique(30), "en", "a", 7)]
    out = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out) == [(i, unique(i), len(unique(i)) if i < 30 else 7) for i in range(31)]
