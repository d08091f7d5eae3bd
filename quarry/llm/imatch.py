"""I-Match document fingerprints.

Terms (words with A-Z in lower case) whose inverse document frequency lies in a band form the lexicon. A document's
distinct lexicon terms, in sorted order of their hashes, are hashed once for each of several randomised subsets of
the lexicon; two documents agree on a subset if they hold the same of its terms. So that texts of any length can
agree after edits, subsets come in scales: at scale s a term is in each subset with probability 4**-s, and a
document uses the two neighbouring scales where its subsets hold a few terms. Likeness is the share of equal hashes
among the subsets that either document has terms in, over the scales both use. A document without lexicon terms is
fingerprinted by all its terms.

Scale: document frequencies are kept in a hashed table of fixed size (``sketch``), of which one bit a slot, 512 KB,
is shipped. Neighbours by id are met by one range shuffle of the texts and a walk over each sorted range; only the
first and last document of a range meet those of other ranges. No group is collected.

Defined results: a null text is the empty text; ids are ordered with null first, equal ids by the text's hash; a single
document is its own successor; documents without words have equal (empty) fingerprints and likeness 1 with each
other, 0 with others; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import sketch
from quarry.llm.common import as_text, cut, lower_ascii, mix64, read_table, restored, word_hashes

#: The band of document frequencies, as shares of all documents, and the least number of documents.
BAND = (1 / 5000, 1 / 50)
LEAST_DOCS = 2
#: Subsets at a scale, and the highest scale.
SUBSETS = 32
SCALES = 7
SEED = 0x1B873593

_LANES = mix64(np.arange(1, SUBSETS // 4 + 1, dtype=np.uint64) * np.uint64(SEED))


def term_sets(texts: list[object]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's words."""
    out = [np.empty(0, dtype=np.uint64)] * len(texts)
    for lo, words, offsets in word_hashes([lower_ascii(as_text(t)) for t in texts]):
        for i in range(len(offsets) - 1):
            if offsets[i + 1] > offsets[i]:
                out[lo + i] = np.unique(words[offsets[i] : offsets[i + 1]])
    return out


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> bytes:
    """One bit for each slot of the hashed table: its document frequency lies in the band."""
    n, counts = sketch.collected(sketch.frequencies(docs, text_col, term_sets))
    counts = counts - sketch.chance(counts)
    inside = (counts >= max(LEAST_DOCS, band[0] * n)) & (counts <= max(LEAST_DOCS, band[1] * n))
    return np.packbits(inside).tobytes()


def fingerprint(terms: np.ndarray, inside: np.ndarray) -> str:
    """``scale:hashes/scale:hashes`` with 4 hexadecimal digits a subset, 0000 for one without terms."""
    known = terms[inside[sketch.slots(terms)]] if len(terms) else terms
    t = known if len(known) else terms
    if not len(t):
        return ""
    lanes = mix64(t[:, None] ^ _LANES[None, :]).view("<u2").reshape(len(t), SUBSETS)
    first = min(SCALES - 1, max(0, int(np.log2(len(t))) // 2))
    value = mix64(t * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    out = []
    for s in (first, first + 1):
        held = lanes < (1 << (16 - 2 * s))
        sums = np.where(held, value[:, None], np.uint64(0)).sum(axis=0, dtype=np.uint64)
        codes = (mix64(sums) % np.uint64(65535) + np.uint64(1)).astype(">u2")
        codes[~held.any(axis=0)] = 0
        out.append(f"{s}:{codes.tobytes().hex()}")
    return "/".join(out)


def _scales(fp: str) -> dict[str, np.ndarray]:
    return {s: np.frombuffer(bytes.fromhex(h), dtype=">u2") for s, _, h in (x.partition(":") for x in fp.split("/"))} if fp else {}


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _scales(a), _scales(b)
    equal = either = 0
    for s in x.keys() & y.keys():
        some = (x[s] > 0) | (y[s] > 0)
        either += int(some.sum())
        equal += int((some & (x[s] == y[s])).sum())
    return equal / either if either else 0.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], prints: list[str], inside: np.ndarray) -> list[tuple]:
    """Results for all but the last of consecutive documents."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    marks = [fingerprint(t, inside) for t in term_sets(changed)]
    return [
        (ids[k], len(texts[k]), hashlib.sha256(changed[k].encode("utf-8", "replace")).hexdigest(), prints[k], marks[k], likeness(prints[k], marks[k]), likeness(prints[k], prints[k + 1]))
        for k in range(len(changed))
    ]


_OUT = ["i", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(lexicon(docs, text_col, band))
    fields = "i string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        inside = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        part = TaskContext.get().partitionId()
        first = last = None
        for b in batches:
            ids, texts = b["i"].tolist(), [as_text(t) for t in b["t"]]
            prints = [fingerprint(t, inside) for t in term_sets(texts)]
            if not ids:
                continue
            first = first or (ids[0], texts[0])
            if last:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            rows = _rows(ids, texts, prints, inside)
            last = (ids[-1], texts[-1], prints[-1])
            if rows:
                yield pd.DataFrame(rows, columns=_OUT).assign(part=-1, text=None, head=None)
        if last:
            yield pd.DataFrame([(last[0], len(last[1]), None, None, None, None, None, part, last[1], first[1])], columns=[*_OUT, "part", "text", "head"])

    # Range partitions in the order of (id, text); the text's hash keeps equal ids together or apart alike.
    ordered = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).withColumn("h", F.xxhash64("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ordered.repartitionByRange(parts, F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h").select(F.col("i").cast("string").alias("i"), "t")
    walked = cut(ranged.mapInPandas(walk, f"{fields}, part int, text string, head string"))
    ends = walked.where("part >= 0")
    # Numbers of the ranges that hold rows: as many as partitions.
    order = sorted(r.part for r in ends.select("part").collect())
    after = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)], "part int, next int")
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("following"))
    tails = ends.select("i", "part", "text").join(after, "part").join(heads, "next").select("i", "text", "following")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        for b in batches:
            rows = []
            for i, t, f in zip(b["i"], b["text"], b["following"], strict=True):
                rows += _rows([i, None], [t, f], [fingerprint(x, inside) for x in term_sets([t, f])], inside)
            yield pd.DataFrame(rows, columns=_OUT)

    done = walked.where("part < 0").select(*_OUT).unionByName(tails.mapInPandas(finish, fields))
    return restored(done, docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
