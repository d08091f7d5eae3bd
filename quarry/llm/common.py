"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's counterpart of WORD's separator, for ``split``.
SPACES = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch: Spark's default, and what suits whole texts (a batch is in memory several times over).
_USUAL_ROWS, TEXT_ROWS = "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless another size than Spark's default is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", _USUAL_ROWS) == _USUAL_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder. One of its own is set only in local mode (tests); elsewhere a
    machine's folder isn't shared, so none is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/quarry")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors don't replay its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_filter(df: DataFrame, key: str, bits: int = 24) -> Callable[[Column], Column]:
    """A test of 64-bit hashes by a filter of 2**bits bits: true for all of ``df``'s keys, and for a share of others.
    At most 2**bits / 64 numbers come to the driver, whatever the input."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    word = F.floor(slot / 64).cast("int").alias("w")
    table = np.zeros((1 << bits) // 64, dtype=np.int64)
    for r in df.select(word, (slot % 64).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).collect():
        table[r.w] = r.bits
    sent = df.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_hold(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy() % (1 << bits)
        return pd.Series((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return may_hold


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], count: str, rows: int) -> DataFrame:
    """Inner join on ``key``; right has one row a key, with the number of its rows in left as ``count`` (dropped).
    Keys with more than a small share of left's ``rows`` rows, of which there can't be many, are joined by broadcast, so
    that no key's rows meet in a task."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = rows / (8 * tasks)  # so at most 8 * tasks keys are over it
    hot, cold = right.where(F.col(count) > bound).drop(count), right.where(F.col(count) <= bound).drop(count)
    rest = left.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def n_words(text: Column) -> Column:
    """Words of a text as a long: word starts are counted, no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def carried(df: DataFrame, col: str) -> Column:
    """A column as text named i: pandas would turn integers with nulls into floats."""
    return df[col].cast("string").alias("i")


def restored(out: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """``out`` with the carried column under its own name and type again."""
    return out.withColumn("i", F.col("i").cast(df.schema[col].dataType)).withColumnRenamed("i", col)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def missing(value: object) -> bool:
    """Null as pandas hands it over: None, NaN or NA."""
    return value is None or value is pd.NA or (isinstance(value, float) and value != value)


def as_text(value: object) -> str:
    return "" if missing(value) else str(value)


def sliced(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of fewer rows, for results that are larger than what they are made from."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.iloc[lo : lo + rows]


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def trimmed(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` body that hands freed memory back at its end: workers are used again by later tasks."""

    @functools.wraps(fn)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return run


# --- vectorised hashing of words and shingles -------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; one longer text gets a block of its own.
BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word that are hashed at a time; masks that keep the first bytes of such a chunk.
_CHUNK = 8
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(_CHUNK)] + [(1 << 64) - 1], dtype=np.uint64)
#: Chunks that are handled for all words together, and the keys of their places.
_PLACES = 8
_PLACE_KEYS = mix64(np.arange(1, _PLACES + 1, dtype=np.uint64) * _MULT)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: (index of the block's first text, 64-bit hash of each word, offsets of the
    texts' words in it). A word is cut into chunks of eight bytes; each is mixed with its place in the word, and the
    word's hash mixes the sum of its chunks with its length. (A polynomial of the bytes modulo 2**64 won't do: words of
    two letters in Thue-Morse order and their complements are equal under any base.)"""
    for lo, hi in _blocks(texts):
        joined = b" ".join(texts[lo:hi]) + b" "
        raw = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        size = ends - starts
        # Eight bytes from each place on, as a number.
        eight = np.ndarray(shape=len(raw), dtype="<u8", buffer=joined + bytes(_CHUNK), strides=(1,))
        sums = mix64((eight[starts] & _KEEP[np.minimum(size, _CHUNK)]) ^ _PLACE_KEYS[0])
        longer = np.flatnonzero(size > _CHUNK)
        for place in range(1, _PLACES):
            left = size[longer] - place * _CHUNK
            chunk = eight[starts[longer] + place * _CHUNK] & _KEEP[np.minimum(left, _CHUNK)]
            sums[longer] += mix64(chunk ^ _PLACE_KEYS[place])
            longer = longer[left > _CHUNK]
        for k in longer:  # words of over 64 bytes, each at once
            place = np.arange(_PLACES, -(-int(size[k]) // _CHUNK))
            chunk = eight[starts[k] + place * _CHUNK] & _KEEP[np.minimum(size[k] - place * _CHUNK, _CHUNK)]
            sums[k : k + 1] += mix64(chunk ^ mix64(place.astype(np.uint64) * _MULT + _MULT)).sum(dtype=np.uint64)
        words = mix64(sums + size.astype(np.uint64) * _MULT)
        begins = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts[lo:hi]], out=begins[1:])
        yield lo, words, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles. A text of fewer words has its whole
    sequence as its only shingle; one without words has none."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    coef = mix64(np.arange(1, k + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
    for lo, words, offsets in word_hashes(texts):
        m = max(0, len(words) - k + 1)
        rolled = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            rolled += words[j : j + m] * coef[j]
        rolled = mix64(rolled)
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            if b - a >= k:
                out[lo + i] = np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = words[a:b] * coef[: b - a]
                out[lo + i] = mix64(np.array([(int(short.sum(dtype=np.uint64)) + int(b - a) * int(_MULT)) % (1 << 64)], dtype=np.uint64))
    return out


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case, other letters as they are."""
    return utf8(text).lower()
