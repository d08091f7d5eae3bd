"""Routines as Spark SQL scripts, transactions as snapshots, cursors over ordered results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.plans.sqlparse import split_statements


class Routines:
    """Stored procedures and functions of a session. A body is a Spark SQL script with ``:name`` parameters."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.bodies: dict[str, tuple[tuple[str, ...], str]] = {}

    def create_procedure(self, name: str, parameters: Sequence[str], body: str, or_replace: bool = False) -> None:
        if name.lower() in self.bodies and not or_replace:
            raise ValueError(f"procedure {name} exists")
        self.bodies[name.lower()] = (tuple(parameters), body)

    def call(self, name: str, *args: object) -> DataFrame:
        parameters, body = self.bodies[name.lower()]
        return self.spark.sql(body, dict(zip(parameters, args, strict=True)))

    def create_function(self, name: str, parameters: dict[str, str], returns: str, expression: str) -> None:
        """A scalar SQL function: inlined by Catalyst, no Python."""
        args = ", ".join(f"{k} {t}" for k, t in parameters.items())
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {expression}")

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.bodies.pop(name.lower(), None) is None and not if_exists:
            raise KeyError(name)


class Transaction:
    """BEGIN, SAVEPOINT, ROLLBACK, COMMIT over named tables. Tables are immutable plans, so a savepoint is a copy of
    the names; nothing is computed or copied until a result is asked for."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.begun, self.tables = dict(tables), dict(tables)
        self.savepoints: list[tuple[str, dict[str, DataFrame]]] = []

    def savepoint(self, name: str) -> None:
        self.savepoints.append((name, dict(self.tables)))

    def _find(self, name: str) -> int:
        return next(k for k in range(len(self.savepoints) - 1, -1, -1) if self.savepoints[k][0] == name)

    def rollback(self, to: str | None = None) -> None:
        if to is None:
            self.tables, self.savepoints = dict(self.begun), []
        else:
            k = self._find(to)
            self.tables = dict(self.savepoints[k][1])
            del self.savepoints[k + 1 :]

    def release(self, name: str) -> None:
        del self.savepoints[self._find(name) :]

    def commit(self) -> dict[str, DataFrame]:
        self.begun, self.savepoints = dict(self.tables), []
        return self.begun


class Cursor:
    """FETCH NEXT, PRIOR, FIRST, LAST, ABSOLUTE n and RELATIVE n over a result in a stated order.

    Positions are numbered once, range by range: the rows are range-partitioned and sorted, ranges counted, and their
    numbers offset, so no task holds them all; the numbered result is kept in Spark's cache until ``close``."""

    def __init__(self, df: DataFrame, order_by: Sequence[Column | str]):
        parts = df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id())
        parts = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))).cache()
        sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
        start, offsets = 0, []
        for p in sorted(sizes):
            offsets.append((p, start))
            start += sizes[p]
        table = df.sparkSession.createDataFrame(offsets, "_part int, _from long")
        self.parts, self.size, self.at = parts, start, 0
        self.rows = parts.join(F.broadcast(table), "_part").withColumn("_pos", F.col("_in") + F.col("_from")).drop("_in", "_from", "_part")

    def fetch(self, where: str = "next", n: int = 1) -> Row | None:
        to = {"next": self.at + 1, "prior": self.at - 1, "first": 1, "last": self.size, "absolute": n if n >= 0 else self.size + 1 + n, "relative": self.at + n}[where.lower()]
        self.at = max(0, min(to, self.size + 1))
        return self.rows.where(F.col("_pos") == self.at).drop("_pos").first() if 1 <= self.at <= self.size else None

    def __iter__(self) -> Iterator[Row]:
        yield from self.rows.orderBy("_pos").drop("_pos").toLocalIterator()

    def close(self) -> None:
        self.parts.unpersist()


def statements(files: DataFrame) -> DataFrame:
    """(path, dialect, seq, sql): the statements of files given as (path, dialect, text), in their order. A file
    without statements, or without text, has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [split_statements(t or "", d) for t, d in zip(b["text"], b["dialect"], strict=True)]
            rows = [(p, d, k, s) for p, d, each in zip(b["path"], b["dialect"], found, strict=True) for k, s in enumerate(each)]
            yield pd.DataFrame(rows, columns=["path", "dialect", "seq", "sql"])

    return files.select("path", "dialect", "text").mapInPandas(run, "path string, dialect string, seq int, sql string")
