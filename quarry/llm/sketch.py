"""Document frequencies of hashed terms in a table of fixed size.

Each term falls into one of ``2**BITS`` counters. Tasks count in place and hand on compressed segments, which are
added up as they stream by, in two levels: first those of ``MERGED`` tasks each, so that no task sees all of them. Memory and traffic don't depend on how many terms there are. A counter
also holds the terms that share it; ``chance`` is what the usual counter holds, to be taken off.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import trimmed

BITS = 22
SEGMENT = 1 << 16
#: Tasks whose tables are added up at the first level.
MERGED = 64
_SCHEMA = "segment int, salt int, docs long, counts binary"


def slots(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITS)).astype(np.int64)


def chance(counts: np.ndarray) -> float:
    """What the terms that share a counter amount to: the median, as most counters have no frequent term."""
    return float(np.median(counts))


def _emit(table: np.ndarray, docs: int, salt: int) -> Iterator[pd.DataFrame]:
    for k in range(len(table) // SEGMENT):
        part = table[k * SEGMENT : (k + 1) * SEGMENT]
        if k == 0 or part.any():  # segment 0 carries the number of rows
            yield pd.DataFrame({"segment": pd.Series([k], dtype="int32"), "salt": pd.Series([salt], dtype="int32"), "docs": [docs if k == 0 else 0], "counts": [zlib.compress(part.astype("<u8").tobytes(), 1)]})


def frequencies(docs: DataFrame, text_col: str, sets: Callable[[list[object]], list[np.ndarray]]) -> DataFrame:
    """(segment, docs, counts): for each segment of the table the sums over all rows, a row or none; ``docs`` of
    segment 0 is the number of rows. ``sets`` turns a batch of texts into arrays of distinct uint64 terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, n = np.zeros(1 << BITS, dtype=np.uint32), 0
        for b in batches:
            found = sets(list(b["t"]))
            n += len(found)
            if any(len(x) for x in found):
                table += np.bincount(slots(np.concatenate(found)), minlength=1 << BITS).astype(np.uint32)
        if n:
            yield from _emit(table, n, TaskContext.get().partitionId() // MERGED)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            for k, d, c in zip(b["segment"], b["docs"], b["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(c), dtype="<u8")
                sums[k] = sums[k] + part if k in sums else part
                n[k] = n.get(k, 0) + d
        for k, part in sums.items():
            yield pd.DataFrame({"segment": pd.Series([k], dtype="int32"), "salt": pd.Series([0], dtype="int32"), "docs": [n[k]], "counts": [zlib.compress(part.tobytes(), 1)]})

    texts = docs.select(docs[text_col].alias("t"))
    parts = texts.mapInPandas(trimmed(count), _SCHEMA).repartition("segment", "salt").mapInPandas(trimmed(add), _SCHEMA)
    return parts.repartition("segment").mapInPandas(trimmed(add), _SCHEMA)


def collected(table: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, counters): at most 2**BITS numbers come to the driver, whatever the input."""
    out, n = np.zeros(1 << BITS, dtype=np.uint64), 0
    for r in table.collect():  # 2**BITS / SEGMENT rows at most
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r.counts), dtype="<u8")
        n += r.docs
    return n, out
