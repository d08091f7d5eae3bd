"""Checks of parsed statements against a declared schema.

References are exploded into rows and met with the catalogue by anti-joins; aliases are resolved first. Types are
checked with groups of compatible types.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.dialects import TYPE_GROUPS
from quarry.plans.sqlparse import Node, SqlError, parse

_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")


def missing_tables(analyzed: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, type, message, table, column): tables that aren't declared."""
    refs = analyzed.where("error IS NULL").select("query_id", F.explode("tables").alias("t")).where(F.col("t.usage").isin(*_VERBS)).select("query_id", F.lower("t.name").alias("table"), F.col("t.name").alias("shown")).distinct()
    known = columns.select("table").distinct()
    return refs.join(known, "table", "left_anti").select("query_id", F.lit("TABLE_NOT_FOUND").alias("type"), F.concat(F.lit("Table '"), "shown", F.lit("' not found in schema")).alias("message"), F.col("shown").alias("table"), F.lit(None).cast("string").alias("column"))


def missing_columns(analyzed: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns that their table (through its alias), or none of the statement's tables, has. Columns of statements
    with undeclared or derived sources can't be told and are left out where unqualified."""
    ok = analyzed.where("error IS NULL").select("query_id", "tables", "columns", F.col("facts.query_type").alias("kind"))
    sources = ok.select("query_id", F.explode("tables").alias("t")).select("query_id", F.lower(F.when(F.col("t.alias") != "", F.col("t.alias")).otherwise(F.col("t.name"))).alias("alias"), F.lower("t.name").alias("table"), F.col("t.name").alias("shown")).distinct()
    names = sources.select("query_id", F.col("table").alias("alias"), "table", "shown")
    sources = sources.unionByName(names).distinct()
    declared = columns.select("table", F.col("column").alias("col")).distinct()
    refs = ok.select("query_id", "kind", F.posexplode("columns").alias("seq", "c")).where(F.col("c.usage").isin("SELECT", "WHERE", "JOIN", "GROUP_BY", "HAVING", "INSERT", "UPDATE", "DELETE")).select("query_id", "kind", "seq", F.lower("c.table").alias("alias"), F.lower("c.name").alias("col"), F.col("c.name").alias("shown_col"))
    qualified = refs.where("alias <> ''").join(sources, ["query_id", "alias"]).join(declared.select("table").distinct(), "table", "left_semi").join(declared, ["table", "col"], "left_anti").select("query_id", F.concat(F.lit("Column '"), "shown_col", F.lit("' not found in table '"), "shown", F.lit("'")).alias("message"), F.col("shown").alias("table"), F.col("shown_col").alias("column"))
    undeclared = sources.join(declared.select("table").distinct(), "table", "left_anti").select("query_id").distinct()
    bare = refs.where("alias = '' AND kind NOT LIKE 'WITH%'").join(undeclared, "query_id", "left_anti")
    found = bare.join(sources.select("query_id", "table").distinct(), "query_id").join(declared, ["table", "col"], "left_semi").select("query_id", "seq").distinct()
    none = bare.join(found, ["query_id", "seq"], "left_anti").join(sources.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.concat(F.lit("Column '"), "shown_col", F.lit("' not found in any table")).alias("message"), F.lit(None).cast("string").alias("table"), F.col("shown_col").alias("column"))
    return qualified.unionByName(none).distinct().select("query_id", F.lit("COLUMN_NOT_FOUND").alias("type"), "message", "table", "column")


def validate(analyzed: DataFrame, columns: DataFrame | None) -> DataFrame:
    """All errors. Without a schema each statement has one SCHEMA_NOT_LOADED."""
    if columns is None:
        none = F.lit(None).cast("string")
        return analyzed.select("query_id", F.lit("SCHEMA_NOT_LOADED").alias("type"), F.lit("No schema loaded").alias("message"), none.alias("table"), none.alias("column"))
    return missing_tables(analyzed, columns).unionByName(missing_columns(analyzed, columns))


def _group(t: str) -> str:
    return TYPE_GROUPS.get(t.upper(), t.upper())


def infer(n: Node, types: dict[str, str]) -> str | None:
    """A declared type for an expression, None where it can't be told."""
    if n.kind == "lit":
        kind = n.get("type")
        return {"string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "null": None}.get(kind, "FLOAT" if isinstance(n.value, float) else "INT")
    if n.kind == "column":
        return types.get(f"{n.table}.{n.value}".lower().lstrip("."))
    if n.kind == "cast":
        return n.value.split("(")[0]
    if n.kind == "func":
        if n.value in ("COUNT", "SUM", "LENGTH", "YEAR", "MONTH", "DAY"):
            return "INT"
        if n.value == "AVG":
            return "FLOAT"
        if n.value in ("MIN", "MAX", "COALESCE", "ABS") and n.kids:
            return infer(n.kids[0], types)
        if n.value in ("CONCAT", "SUBSTRING", "UPPER", "LOWER", "TRIM", "REPLACE"):
            return "VARCHAR"
        return {"NOW": "TIMESTAMP", "CURRENT_TIMESTAMP": "TIMESTAMP", "CURRENT_DATE": "DATE"}.get(n.value)
    if n.kind == "binary" and n.value in ("+", "-", "*", "/", "%"):
        a, b = (infer(k, types) for k in n.kids)
        return a if a and b and _group(a) == _group(b) else None
    if n.kind == "binary" and n.value == "||":
        return "VARCHAR"
    return None


_BOOLEAN = {"AND", "OR", "XOR", "=", "==", "<>", "!=", "<", ">", "<=", ">=", "<=>", "IS DISTINCT FROM"}


def type_errors(tree: Node, schema: dict[str, dict[str, str]]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(type, message, table, column) of one statement. ``schema``: table to column to type, in lower case."""
    for n in tree.walk():
        if n.kind == "insert":
            declared = schema.get(n.value.lower(), {})
            columns = n.columns or list(declared)
            for r in n.get("rows", []):
                if columns and len(r.kids) != len(columns):
                    yield "COLUMN_COUNT_MISMATCH", f"{len(columns)} columns, {len(r.kids)} values", n.value, None
                    continue
                for c, v in zip(columns, r.kids, strict=False):
                    yield from _assigned(n.value, c, v, declared, {})
        elif n.kind == "update":
            declared = schema.get(n.value.lower(), {})
            for a in n.assignments:
                yield from _assigned(n.value, a.value, a.kids[0], declared, declared)
        if n.kind in ("select", "update", "delete"):
            types: dict[str, str] = {}
            refs = [r for r in [*n.get("from", []), *n.kids, *(j.kids[0] for j in n.get("joins", []))] if r.kind == "table"]
            for r in refs:
                for c, t in schema.get(r.value.lower(), {}).items():
                    types.setdefault(c, t)
                    types[f"{(r.get('alias') or r.value).lower()}.{c}"] = t
            where = n.get("where")
            if where is not None:
                yield from _boolean(where, types)


def _assigned(table: str, column: str, value: Node, declared: dict[str, str], types: dict[str, str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    want, got = declared.get(column.lower()), infer(value, types)
    if want and got and _group(want) != _group(got) and not (_group(want) == "datetime" and _group(got) == "string"):
        yield "TYPE_MISMATCH", f"Type mismatch for column '{column}': expected {want}, got {got}", table, column


def _boolean(n: Node, types: dict[str, str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    if n.kind == "binary" and n.value in ("AND", "OR", "XOR"):
        for k in n.kids:
            yield from _boolean(k, types)
    elif n.kind == "unary" and n.value == "NOT":
        yield from _boolean(n.kids[0], types)
    elif n.kind == "binary" and n.value in _BOOLEAN:
        a, b = (infer(k, types) for k in n.kids)
        if a and b and _group(a) != _group(b) and {_group(a), _group(b)} != {"datetime", "string"}:
            yield "TYPE_MISMATCH", f"Type mismatch in comparison: {a} vs {b}", None, None
    elif n.kind == "in" and n.get("query") is None:
        a = infer(n.kids[0], types)
        for k in n.kids[1:]:
            b = infer(k, types)
            if a and b and _group(a) != _group(b):
                yield "TYPE_MISMATCH", f"Type mismatch in IN clause: {a} vs {b}", None, None
    elif n.kind == "binary" or (n.kind == "lit" and n.get("type") in ("number", "string")):
        yield "NON_BOOLEAN_EXPRESSION", f"Operator '{n.value}' doesn't give a boolean", None, None


def check_types(workload: DataFrame, columns: DataFrame) -> DataFrame:
    """Type errors of (query_id, sql, dialect). The schema is declared, of bounded size, and goes with the tasks."""
    schema: dict[str, dict[str, str]] = {}
    for r in columns.select("table", "column", "type").collect():
        schema.setdefault(r["table"], {})[r["column"]] = r["type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, s, d in zip(b["query_id"], b["sql"], b["dialect"], strict=True):
                try:
                    rows += [(q, *e) for e in type_errors(parse(s or "", d), schema)]
                except (SqlError, RecursionError):
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "type", "message", "table", "column"])

    kind = workload.schema["query_id"].dataType.simpleString()
    return workload.select("query_id", "sql", "dialect").mapInPandas(run, f"query_id {kind}, type string, message string, table string, column string")
