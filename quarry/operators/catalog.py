"""Declared tables: DDL statements act on catalogue rows, and constraints are queries over the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = ""
    on_update: str = ""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    nullable: bool = False
    primary_key: bool = False
    unique: bool = False
    default: str | None = None
    foreign_key: tuple[str, str] | None = None


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: str = ""
    columns: tuple[ColumnDef, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[tuple[str, tuple[str, ...], bool], ...] = ()

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass
class Catalog:
    """Names are case-insensitive; a statement that can't act raises KeyError or ValueError."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, dict[str, str]] = field(default_factory=dict)

    def create_table(self, table: TableDef, if_not_exists: bool = False) -> None:
        if table.name.lower() in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {table.name} exists")
        self.tables[table.name.lower()] = table

    def drop(self, kind: str, name: str, if_exists: bool = False) -> None:
        if kind == "index":
            for k, t in self.tables.items():
                if any(i[0] == name for i in t.indexes):
                    self.tables[k] = replace(t, indexes=tuple(i for i in t.indexes if i[0] != name))
                    return
        else:
            store = {"table": self.tables, "view": self.views, "trigger": self.triggers}[kind]
            if store.pop(name.lower(), None) is not None:
                return
        if not if_exists:
            raise KeyError(f"{kind} {name}")

    def alter(self, name: str, change) -> None:
        self.tables[name.lower()] = change(self.tables[name.lower()])

    def add_column(self, table: str, column: ColumnDef) -> None:
        self.alter(table, lambda t: replace(t, columns=(*t.columns, column)))

    def drop_column(self, table: str, column: str) -> None:
        self.alter(table, lambda t: replace(t, columns=tuple(c for c in t.columns if c.name.lower() != column.lower())))

    def create_index(self, name: str, table: str, columns: Sequence[str], unique: bool = False) -> None:
        self.alter(table, lambda t: replace(t, indexes=(*t.indexes, (name, tuple(columns), unique))))

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name.lower(), c.name.lower(), c.type.upper(), c.length, c.precision, c.scale, c.nullable, c.primary_key, c.unique, c.default) for t in self.tables.values() for c in t.columns]
        return spark.createDataFrame(rows, "table string, column string, type string, length int, precision int, scale int, nullable boolean, is_pk boolean, is_unique boolean, default string")

    def foreign_keys_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name.lower(), c.name.lower(), c.foreign_key[0].lower(), c.foreign_key[1].lower()) for t in self.tables.values() for c in t.columns if c.foreign_key]
        rows += [(t.name.lower(), a.lower(), k.table.lower(), b.lower()) for t in self.tables.values() for k in t.foreign_keys for a, b in zip(k.columns, k.references, strict=True)]
        return spark.createDataFrame(rows, "table string, column string, ref_table string, ref_column string")

    def broken_foreign_keys(self, spark: SparkSession) -> DataFrame:
        """Every foreign key whose target table or column isn't declared."""
        known = self.columns_frame(spark).select(F.col("table").alias("ref_table"), F.col("column").alias("ref_column"))
        return self.foreign_keys_frame(spark).join(known, ["ref_table", "ref_column"], "left_anti").select("table", "column", "ref_table", "ref_column")


def foreign_key_violations(child: DataFrame, parent: DataFrame, columns: Sequence[str], references: Sequence[str]) -> DataFrame:
    """Child rows whose key is complete and isn't in the parent."""
    cond = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(columns, references, strict=True)]
    complete = child.dropna(subset=list(columns))
    return complete.alias("c").join(parent.alias("p"), cond, "left_anti")


def key_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls in each column that may hold none: one pass."""
    sums = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in columns))).alias("x")).select("x.*").where("n > 0")


def alter_frame(df: DataFrame, add: dict[str, str] | None = None, drop: Sequence[str] = (), rename: dict[str, str] | None = None, retype: dict[str, str] | None = None) -> DataFrame:
    """ALTER TABLE on the data: ADD (nulls of a type), DROP, RENAME/CHANGE, MODIFY (cast); metadata only, no shuffle."""
    out = df.drop(*drop)
    for c, t in (retype or {}).items():
        out = out.withColumn(c, F.col(c).cast(t))
    out = out.withColumnsRenamed(rename or {})
    for c, t in (add or {}).items():
        out = out.withColumn(c, F.lit(None).cast(t))
    return out
