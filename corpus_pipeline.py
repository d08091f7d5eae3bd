"""A corpus from raw documents: quality rules, near copies, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of its docs, and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``; the last one returns what is trained on.

Nulls are handled as the operators say: documents without words fail the quality rules; a null source is a source
of its own; repeated rows are copies of one document, and one of them stays.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe_codec, jaccard, mixing, pii, quality
from quarry.llm.common import cut, ensure_checkpoint_dir, in_filter, read_table

#: Decisions (three numbers each) that are broadcast at most; more are shuffled with the texts in question.
BROADCAST_ROWS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and common lines of the others; n_chars follows a text that lost lines."""
    out = quality.cleaned(docs.select(*COLUMNS).withColumn("whole", F.char_length("text")))
    now = F.char_length("text")
    return out.withColumn("n_chars", F.when(now < F.col("whole"), now.cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays (with equal ids, the smallest text
    hash, then one row). Documents without words have no links and stay, repeated rows of theirs once.

    A filter of fixed size holds the (id, text) hashes of the rows that go or are repeated; only texts that it may hold
    are shuffled, to the exact decision."""
    docs = docs.select(*COLUMNS)
    found = cut(jaccard.join(docs))
    same = ("doc_id", "th")
    lead = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), *same)).alias("x"))
    stay = lead.select("x.doc_id", "x.th").unionByName(found.where("n_shingles = 0").select(*same).distinct()).withColumn("stays", F.lit(1))
    texts = found.groupBy(*same).agg(F.count("*").alias("n"))
    hit = texts.doc_id.eqNullSafe(stay.doc_id) & texts.th.eqNullSafe(stay.th)
    decided = cut(texts.join(stay, hit, "left").select(texts.doc_id, texts.th, "n", F.col("stays").isNotNull().alias("stays")))
    open_ = decided.where("not stays or n > 1").withColumn("key", F.xxhash64(*same))
    flagged = in_filter(open_, "key")
    rows = docs.withColumn("_th", F.xxhash64("text"))
    asked = flagged(F.xxhash64("doc_id", "_th"))
    go = F.broadcast if open_.count() <= BROADCAST_ROWS else lambda x: x
    k = open_.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), "n", "stays")
    kept = rows.where(asked).join(go(k), F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("_th").eqNullSafe(F.col("k_th")), "left")
    kept = kept.where("stays is null or stays")
    once = kept.where("n > 1").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("n is null or n = 1"))
    return rows.where(~asked).select(*COLUMNS).unionByName(once.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, and of parts just the words taken."""
    return mixing.mixture(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids for training, with counts and digests of ids and of the bytes they decode to."""
    return bpe_codec.digests(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("personal_data", personal_data),
    ("source_mixing", mixed),
    ("bpe_codec", tokens),
]


def _remove(spark: SparkSession, folder: str) -> None:
    """A folder on whatever file system it is; nothing if the session has ended."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared checkpoint folder and read again. What a stage has
    read is removed when its result is written; the last stage's input stays for whoever runs the result, and goes when
    the driver ends."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, base)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        if k:
            _remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: Spans of the semi-Markov field and token ids aren't expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None
