"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe_codec, html_text, imatch, jaccard, mixing, pii, quality, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text.query,
    "op2_imatch": imatch.query,
    "op3_token_counts": token_counts.query,
    "op4_line_quality": quality.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_toxicity": toxicity.query,
    "op7_source_mixing": mixing.query,
    "op8_personal_data": pii.query,
    "op9_bpe_codec": bpe_codec.query,
    "op10_url_filter": url_filter.query,
}

ORACLES: dict[str, str] = {"op4_line_quality": quality.SQL, "op5_ngram_jaccard": jaccard.SQL}
