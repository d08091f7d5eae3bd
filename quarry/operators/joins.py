"""Joins that a plain equality doesn't express: by range, by time, and with hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bins that one interval stands in at most (but for one more at its end), and the growth of bins from level to level.
BINS = 64

#: Keys that are joined in parts at most.
HOT_KEYS = 1000


def range_join(left: DataFrame, right: DataFrame, value: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= value <= high. Values and intervals (inclusive) are cut into bins; an interval stands in each
    bin it touches and a value in one, so the join has an equality key and each pair comes up once.

    Bins of level 0 have ``width``, those of each further level 64 times the last one's. An interval goes to the lowest
    level where it touches at most 65 bins, so a wide one isn't spread over any number of rows; a value stands once in
    each level that an interval is in. The levels in use, 16 at most, are found first. Nulls, and intervals whose end
    is before their start, meet nothing. Columns of the two sides must differ in name."""
    span = F.greatest((high - low).cast("double") / width, F.lit(1.0))
    level = F.greatest(F.ceil(F.log(float(BINS), span) - 1e-9) - 1, F.lit(0)).cast("int")
    b = right.where(low <= high).withColumn("_level", level)
    used = sorted(r[0] for r in b.select("_level").distinct().collect())
    size = F.lit(float(width)) * F.pow(F.lit(float(BINS)), F.col("_level"))
    at = lambda c: F.floor(c / size).cast("long")
    a = left.where(value.isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, used or [0])))).withColumn("_bin", at(value))
    b = b.withColumn("_bin", F.explode(F.sequence(at(low), at(high))))
    return a.join(b, ["_level", "_bin"]).where((value >= low) & (value <= high)).drop("_level", "_bin")


def _seconds(time: Column, kind: str) -> Column:
    """A place on the axis of a time or number column."""
    return (time.cast("timestamp") if kind in ("timestamp_ntz", "date") else time).cast("double")


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
    bucket: float | None = None,
) -> DataFrame:
    """For each left row the right row of the same key with the latest time not after it. Both sides stand in one
    window by key and time, so no pair is ever formed. Of right rows with one time the greatest ``columns`` count.

    With ``bucket`` (seconds, or units of a number) a key's rows are dealt by time as well, so that a hot key isn't in
    one task: each bucket also gets the key's last right row from before it. Only one row for each key and bucket
    meets in a window by key alone. A null time matches nothing, and a null key only a null key."""
    packed = F.struct(*columns)
    kind = left.schema[left_time].dataType.typeName()
    a = left.select(
        *by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_r"),
    )
    b = right.where(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"),
        packed.alias("_r"),
    )
    rows, keys = a.unionByName(b), list(by)
    if bucket is not None:
        rows = rows.withColumn("_b", F.floor(_seconds(F.col("_t"), kind) / bucket).cast("long"))
        latest = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r")))
        before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = rows.groupBy(*by, "_b").agg(latest.alias("_x")).withColumn("_x", F.last("_x", ignorenulls=True).over(before))
        carry = carry.where("_x IS NOT NULL AND _b IS NOT NULL").select(
            *by, "_x._t", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_x._r", "_b"
        )
        rows, keys = rows.unionByName(carry), [*by, "_b"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return met.select("_l.*", *(F.col(f"_m.{c}").alias(c) for c in columns))


def _hot(left: DataFrame, on: str, least: int) -> DataFrame | None:
    """The keys with ``least`` left rows or more, of which the ``HOT_KEYS`` most frequent, as a table of one column."""
    counts = left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    found = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(on)
    keys, spark = found._jdf.collectAsList(), left.sparkSession  # not through Python or Arrow, which lack some types
    return DataFrame(spark._jsparkSession.createDataFrame(keys, found._jdf.schema()), spark) if keys.size() else None


def _dealt(left: DataFrame, right: DataFrame, on: str, hot: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: left rows of hot keys (and of null, which meets nothing) by their hash, right rows of
    hot keys once for each salt, all others 0."""
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    by_hash = F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(salts)).cast("int")
    a = left.join(marked, on, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(on).isNull(), by_hash).otherwise(F.lit(0)))
    every, first = F.array(*map(F.lit, range(salts))), F.array(F.lit(0))
    b = right.join(marked, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(first)))
    return a.drop("_hot"), b.drop("_hot")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner", least: int = 10_000) -> DataFrame:
    """An inner or left join for keys that are hot on the left: left rows of a hot key are dealt to ``salts`` parts, and
    only that key's right rows are repeated for each. Other keys are joined as they are.

    Keys with ``least`` left rows or more are hot, at most ``HOT_KEYS`` of them; they are found first, so the left side
    is read twice. A key that isn't among them has under ``least`` rows or under a ``HOT_KEYS``-th of all. Both
    sides are shuffled and sorted, never broadcast: Spark's estimate of a side's size doesn't see repeated rows."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = _hot(left.where(F.col(on).isNotNull()) if how == "inner" else left, on, least)
    if hot is None:
        return left.join(right.hint("merge"), on, how)
    a, b = _dealt(left, right, on, hot, salts)
    return a.join(b.hint("merge"), [on, "_salt"], how).drop("_salt")


def top_percent(df: DataFrame, percent: float, order_by: Sequence[Column | str]) -> DataFrame:
    """SELECT TOP n PERCENT: the first ceil(n / 100 * rows). The number comes first, so a top-k does the rest."""
    import math

    n = df.count()
    return df.orderBy(*order_by).limit(math.ceil(n * percent / 100))
