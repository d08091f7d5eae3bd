"""INSERT, UPDATE, DELETE and MERGE as functions from tables to tables.

File tables take no UPDATE, DELETE or MERGE statement, so each is the plan of the table afterwards; writing it out
is the caller's choice (``overwrite``). Predicates are three-valued: a row whose predicate is null is not touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def insert_values(target: DataFrame, rows: Sequence[Sequence[object]], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows for the named columns (all by default); the rest are null."""
    names = list(columns or target.columns)
    fields = {f.name: f for f in target.schema}
    schema = ", ".join(f"`{n}` {fields[n].dataType.simpleString()}" for n in names)
    return insert_select(target, target.sparkSession.createDataFrame([tuple(r) for r in rows], schema), names)


def insert_select(target: DataFrame, source: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The source's columns by position into the named ones; the rest are null."""
    named = source.toDF(*(columns or target.columns))
    full = named.select(*((F.col(f"`{f.name}`") if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))
    return target.unionByName(full)


def _limited(target: DataFrame, predicate: Column, order: Sequence[Column | str], limit: int, key: Sequence[str]) -> DataFrame:
    """Keys of the first ``limit`` rows that satisfy the predicate: a top-k, no global sort."""
    return target.where(predicate).orderBy(*(_col(o) if isinstance(o, str) else o for o in order), *key).limit(limit).select(*key, F.lit(True).alias("_hit"))


def update(target: DataFrame, assignments: dict[str, Column | str], where: Column | str | None = None, order_by: Sequence[Column | str] = (), limit: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """All assignments see the row as it was. With a limit, ``key`` names the columns that identify a row."""
    hit = F.lit(True) if where is None else F.coalesce(_col(where), F.lit(False))
    rows = target
    if limit is not None:
        rows = target.join(_limited(target, hit, order_by, limit, key), list(key), "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    types = {f.name: f.dataType for f in target.schema}
    return rows.select(*((F.when(hit, _col(assignments[c]).cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in assignments else F.col(f"`{c}`")) for c in target.columns))


def delete(target: DataFrame, where: Column | str | None = None, order_by: Sequence[Column | str] = (), limit: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(_col(where), F.lit(False))
    if limit is None:
        return target.where(~hit)
    return target.join(_limited(target, hit, order_by, limit, key), list(key), "left_anti").select(*target.columns)


def delete_exists(target: DataFrame, source: DataFrame, on: Column | str) -> DataFrame:
    """DELETE ... WHERE EXISTS: target is aliased t, source s."""
    return target.alias("t").join(source.alias("s"), _col(on), "left_anti")


@dataclass(frozen=True)
class Clause:
    """WHEN ...: kind is matched, not_matched or not_matched_by_source; action update, insert or delete.

    ``values`` maps target columns to expressions over t.* and s.*; a missing column keeps its value (update) or is
    null (insert). ``values`` None takes the source's columns of the same names."""

    kind: str
    action: str
    condition: str | None = None
    values: dict[str, str] | None = field(default=None)


def merge(target: DataFrame, source: DataFrame, on: str, clauses: Sequence[Clause], key: Sequence[str] | None = None) -> DataFrame:
    """The target after MERGE INTO t USING s ON ``on``; for each row the first clause that applies acts.

    One full outer join where ``on`` has an equality (Catalyst finds the keys). Two source rows that would change
    one target row are an error, raised when the plan runs, for which ``key`` names the target's key columns: rows of
    the target must be told apart to see it. Without ``key`` the caller vouches for unique source keys."""
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    joined = t.join(s, F.expr(on), "full")
    in_t, in_s = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
    state = {"matched": in_t & in_s, "not_matched": ~in_t & in_s, "not_matched_by_source": in_t & ~in_s}
    which = F.lit(-1)
    for k in range(len(clauses) - 1, -1, -1):
        c = clauses[k]
        hit = state[c.kind] & (F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True))
        which = F.when(hit, k).otherwise(which)
    rows = joined.withColumn("_which", which)
    if key:
        changes = F.sum(F.when((F.col("_which") >= 0) & in_t & in_s, 1).otherwise(0)).over(Window.partitionBy(*(F.col(f"t.{c}") for c in key)))
        rows = rows.withColumn("_n", F.when(in_t, changes).otherwise(0)).withColumn("_which", F.when(F.col("_n") > 1, F.raise_error("MERGE: more than one source row matches a target row").cast("int")).otherwise(F.col("_which")))
    # Matched by several source rows that change nothing: the target row stays once.
    deletes = [k for k, c in enumerate(clauses) if c.action == "delete"]
    kept = rows.where((in_t | (F.col("_which") >= 0)) & ~F.col("_which").isin(*deletes) if deletes else in_t | (F.col("_which") >= 0))
    out = []
    for f in target.schema:
        value = F.col(f"t.{f.name}")
        for k, c in enumerate(clauses):
            if c.action == "delete":
                continue
            if c.values is None:
                new = F.col(f"s.{f.name}") if f.name in source.columns else F.lit(None)
            elif f.name in c.values:
                new = F.expr(c.values[f.name])
            else:
                new = F.col(f"t.{f.name}") if c.action == "update" else F.lit(None)
            value = F.when(F.col("_which") == k, new.cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return kept.select(*out)


def overwrite(result: DataFrame, path: str) -> None:
    """Write a changed table beside its source and move it in place, since a plan can't overwrite what it reads. The
    old table is moved aside first and deleted last: at each moment a whole table is there under some name, and a
    move that fails is undone and raised."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark.sparkContext._jvm
    now, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next", f"{path}.old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"{path} can't be moved aside; the new table is at {path}.next")
    if not fs.rename(new, now):
        moved = not fs.exists(old) or fs.rename(old, now)
        raise OSError(f"{path}.next can't be moved in place" + ("" if moved else f"; the old table is at {path}.old"))
    fs.delete(old, True)
