"""The mix against a plain walk around each shard's ring of words, and the mixture's texts."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import mixing


def test_taken_brute_force(spark):
    """Each word's place on its shard's ring, counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.limit(2)).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    key = F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")
    rows = docs.select("doc_id", "text", "source", key.alias("k")).collect()
    size = lambda t: len((t or "").encode().split())
    name = lambda s: "n" if s is None else f"s{s}"
    totals, counts = Counter(), Counter()
    for r in rows:
        totals[name(r.source)] += size(r.text)
        counts[name(r.source)] += 1
    plan = {p[0]: p[1:] for p in mixing._source_plan([(s, counts[s], totals[s]) for s in counts], mixing.BLOCK)}
    order = sorted(totals, key=lambda s: (s == "n", s))
    assert [plan[s][2] for s in order] == mixing.targets([totals[s] for s in order])
    rings = defaultdict(list)
    for r in rows:
        rings[name(r.source), r.k % mixing.SLOTS * plan[name(r.source)][0] // mixing.SLOTS].append((r.k, r.doc_id, size(r.text)))
    import numpy as np

    want = Counter()
    for s in order:
        shards = sorted(x for t, x in rings if t == s)
        held = [sum(n for *_, n in rings[s, x]) for x in shards]
        quota = mixing.sainte_lague([float(h) for h in held], [2 * h // mixing.BLOCK for h in held], plan[s][3])
        starts = np.random.default_rng([mixing.SEED, *s.encode()]).integers(0, [max(1, -(-h // mixing.BLOCK)) for h in held])
        for x, h, q, start in zip(shards, held, quota, starts, strict=True):
            ring = [i for _, i, n in sorted(rings[s, x]) for _ in range(n)]
            for k in range(q * mixing.BLOCK):
                want[ring[(int(start) * mixing.BLOCK + k) % h]] += 1
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r.doc_id] += r.taken
    assert +got == +want and sum(got.values()) > 0


def test_mixture_delivers_what_is_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words, whole = Counter(), 0
    for r in mixing.mixture(docs).collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        whole += r.text == texts[r.doc_id]
    assert words == +Counter(taken) and whole > len(texts) / 2


def test_cut_words():
    t = " a  b\nc\u00a0d e "
    assert [mixing.cut_words(t, a, b) for a, b in ((0, 1), (1, 3), (2, 4), (0, 9), (3, 3))] == ["a", "b\nc\u00a0d", "c\u00a0d e", "a  b\nc\u00a0d e", ""]


def test_mixture_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three " * 30, "en", None, 3), (4, "w " * 5000, "de", "b", 9), (4, "w " * 5000, "de", "b", 9), (5, "same", "en", "b", 4)]
    df = spark.createDataFrame(rows, schema)
    got = mixing.mixture(df).collect()
    words = sum(len(r.text.split()) for r in got)
    assert words == df.sparkSession.createDataFrame(mixing.mix(df).collect()).agg(F.sum("taken")).first()[0] and words > 10_000
    assert mixing.mixture(df.limit(0)).count() == 0
