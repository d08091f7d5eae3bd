"""Operators of a training-data pipeline: extraction, fingerprints, counting, filtering,
similarity, toxicity, mixing, personal data, encoding and URL rules.

Nothing outside this subpackage imports it.
"""
