"""Mixing sources to target weights by Sainte-Laguë apportionment.

A document's size is its number of words. Sources, in code-point order with null last, weigh 5, 2, 1, repeating,
and share 150 % of all sizes; no target passes twice its source's size, and what is cut off is shared out again by
weight. Targets are dealt as equal-token blocks: first to sources by highest quotients, then each source's blocks
to its shards (hash ranges of its documents) the same way, so every shard has an integer quota. Inside a shard the
documents stand in seeded order on a ring of tokens, and the quota is the blocks that follow a seeded start block.
How often a document is met is a closed form of its place on the ring, so no block is ever a row.

``mix`` says how many words of each document are taken, ``mixture`` gives the mix itself: a row for each whole round,
and one for each part of a document that the quota's ends cut, with just these words.

Scale: sizes are summed by (source, slot) before they move. One row for each source comes to the driver, whatever the
number of documents; shards' quotas are computed by source, at most ``SLOTS`` rows a task's group. A source with a
third of all rows is up to ``SLOTS`` shards, and documents move once, by (source, shard).

Defined results: a null or empty text has size 0 and is taken 0 times. Null sources are one source. Repeated rows
are separate documents; which of two equal rows is taken more often doesn't show. Without any words all targets
are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import WORD, cut, missing, n_words, read_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Tokens in a block.
BLOCK = 16
#: Hash slots of a source; neighbouring ones are merged until a shard has about SHARD_DOCS documents.
SLOTS = 1024
SHARD_DOCS = 64
SEED = 20240607
#: Rows of the plan (about 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 200_000
_WORD = re.compile(WORD)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(w[i] for i in open_)
        full = {i for i in open_ if w[i] * level > caps[i]}
        for i in full or open_:
            out[i] = float(caps[i] if full else w[i] * level)
        if not full:
            break
        left -= sum(caps[i] for i in full)
        open_ -= full
    return out


def sainte_lague(votes: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients votes/1, votes/3, votes/5 ...; nobody gets more than the cap. Equal quotients:
    the earlier one. A bisected threshold gives all but the last few seats, a heap of next quotients those."""
    v, c = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, c[v > 0].sum())) if len(v) else 0
    if seats <= 0:
        return [0] * len(votes)

    def at(t: float) -> np.ndarray:
        return np.minimum(c, np.floor((v / t + 1) / 2).astype(np.int64))

    low, high = float(v[v > 0].min()) / (2.0 * float(c.max()) + 1), float(v.max()) * 2 + 1
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    got = at(high)
    heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(v.tolist(), got.tolist(), strict=True)) if x > 0 and k < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(heap, (-v[i] / (2 * int(got[i]) + 1), i))
    return got.tolist()


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
    block: int = BLOCK, keep: tuple[str, ...] = (), pieces: bool = False,
) -> DataFrame:
    """(id, *keep, size, source_size, target, taken) for every document. taken: words the mix takes, with repeats.
    With ``pieces``, also how often the whole document is taken and the ranges of words taken beside (rounds,
    pieces)."""
    spark = docs.sparkSession
    source = F.concat(F.when(docs[source_col].isNull(), "n").otherwise("s"), F.coalesce(docs[source_col].cast("string"), F.lit("")))
    key = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    kept = (docs[c].alias(c) for c in keep)
    sized = docs.select(docs[id_col].alias(id_col), *kept, source.alias("_src"), n_words(docs[text_col]).alias("size"), key.alias("_key"))
    sized = sized.withColumn("_slot", F.pmod(F.col("_key"), F.lit(SLOTS)).cast("int"))
    slots = cut(sized.groupBy("_src", "_slot").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    sources = slots.groupBy("_src").agg(F.sum("n"), F.sum("size")).collect()  # a row for each source
    plan = _source_plan([tuple(r) for r in sources], block)
    # From an Arrow table no Python workers are started for it, as they would be from rows.
    by_source = spark.createDataFrame(_plan_table(plan))
    table = _shard_plan(slots, by_source, seed, block)
    # Joined by broadcast the tables cost no shuffle by source, whose hot keys would meet in a task. Beyond this size
    # they're joined like any other.
    if sum(r[1] for r in plan) <= BROADCAST_ROWS:
        table, by_source = F.broadcast(table), F.broadcast(by_source)
    sharded = sized.join(by_source, "_src", "left").withColumn("_shard", _shard())
    order = ("_key", F.col(id_col).asc_nulls_first(), "size")
    w = Window.partitionBy("_src", "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded.withColumn("_end", F.sum("size").over(w)).join(table, ["_src", "_shard"], "left")
    begin, end, n = F.col("_end") - F.col("size"), F.col("_end"), F.greatest(F.col("_n"), F.lit(1).cast("long"))
    rounds, rest = F.floor(F.col("_quota") / n).cast("long"), F.col("_quota") % n
    # The rest of a round is one range of the ring, or two where it runs over the ring's end.
    ranges = [(F.greatest(begin, x) - begin, F.least(end, x + rest) - begin) for x in (F.col("_start"), F.col("_start") - n)]
    over = sum((F.greatest(F.lit(0).cast("long"), b - a) for a, b in ranges), F.lit(0).cast("long"))
    out = placed.withColumn("taken", (rounds * F.col("size") + over).cast("long"))
    extra = []
    if pieces:
        part = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        parts = F.filter(F.array(*(part(a, b) for a, b in ranges)), lambda x: x["b"] > x["a"])
        out, extra = out.withColumn("rounds", rounds).withColumn("pieces", parts), ["rounds", "pieces"]
    return out.select(id_col, *keep, "size", "source_size", "target", "taken", *extra)


def _shard() -> Column:
    return F.floor(F.col("_slot") * F.col("_shards") / F.lit(SLOTS)).cast("int")


def _source_plan(sources: list[tuple[str, int, int]], block: int) -> list[tuple]:
    """A row for each source (name, documents, size): its shards, size, target and blocks."""
    rows = sorted(sources, key=lambda r: (r[0] == "n", r[0][1:]))
    sizes = [r[2] for r in rows]
    want = targets(sizes)
    quotas = sainte_lague(want, [int(MOST * s // block) for s in sizes], round(sum(want) / block))
    return [(s, max(1, min(SLOTS, n // SHARD_DOCS)), size, t, q) for (s, n, size), t, q in zip(rows, want, quotas, strict=True)]


def _plan_table(plan: list[tuple]) -> pa.Table:
    kinds = (("_src", pa.string()), ("_shards", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("_blocks", pa.int64()))
    return pa.table({name: pa.array([r[k] for r in plan], type=kind) for k, (name, kind) in enumerate(kinds)})


def _shard_plan(slots: DataFrame, by_source: DataFrame, seed: int, block: int) -> DataFrame:
    """(source, shard, tokens, quota in tokens, start), a row for each shard with documents."""

    def deal(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("_shard")
        held = d["size"].tolist()
        quota = sainte_lague([float(x) for x in held], [int(MOST * x // block) for x in held], int(d["_blocks"].iloc[0]))
        rng = np.random.default_rng([seed, *d["_src"].iloc[0].encode("utf-8", "replace")])
        starts = rng.integers(0, [max(1, -(-x // block)) for x in held])
        return pd.DataFrame({"_src": d["_src"], "_shard": d["_shard"], "_n": held, "_quota": np.array(quota, dtype=np.int64) * block, "_start": starts * block})

    shards = slots.join(by_source, "_src").withColumn("_shard", _shard()).groupBy("_src", "_shard", "_blocks").agg(F.sum("size").alias("size"))
    return cut(shards.groupBy("_src").applyInPandas(deal, "_src string, _shard int, _n long, _quota long, _start long"))


def cut_words(text: str, a: int, b: int) -> str:
    """The text from its word a to before its word b, with what stands between them."""
    found = itertools.islice(_WORD.finditer(text), a, b)
    first = next(found, None)
    last = first
    for last in found:
        pass
    return text[first.start() : last.end()] if first else ""


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document once for each whole round, and once with each
    range of its words that the mix takes beside; the length column follows such a text. Words by source are those of
    ``taken``. Documents without words aren't in the mix."""
    others = tuple(c for c in docs.columns if c != id_col)
    taken = mix(docs, id_col, text_col, source_col, keep=others, pieces=True).where("taken > 0")
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    each = taken.withColumn("_x", F.explode(F.concat(F.array_repeat(whole, F.col("rounds").cast("int")), F.col("pieces"))))

    @F.pandas_udf("string")
    def part(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if missing(t) else cut_words(t, int(x), int(y)) for t, x, y in zip(texts, a, b, strict=True)], dtype=object)

    partial = (F.col("_x.a") > 0) | (F.col("_x.b") < F.col("size"))
    # Whole texts aren't sent to Python.
    # Called nondeterministic, it isn't evaluated a second time for the length.
    out = each.withColumn("_part", part.asNondeterministic()(F.when(partial, F.col(text_col)), F.col("_x.a"), F.col("_x.b")))
    out = out.withColumn(text_col, F.coalesce("_part", text_col))
    if length_col:
        out = out.withColumn(length_col, F.when(partial, F.char_length("_part").cast("long")).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
