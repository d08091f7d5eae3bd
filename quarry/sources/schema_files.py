"""Declared schemas from JSON or YAML files, and from Spark's own catalogue."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from quarry.operators.catalog import Catalog, ColumnDef, TableDef


def read_text(spark: SparkSession, path: str) -> str:
    """A small file through Spark's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def parse(text: str, kind: str = "") -> dict:
    """JSON or YAML; of unknown kind, JSON first."""
    if kind in ("", "json"):
        try:
            return json.loads(text)
        except ValueError:
            if kind:
                raise
    import yaml

    return yaml.safe_load(text)


def load(spark: SparkSession, path: str) -> Catalog:
    kind = {"json": "json", "yaml": "yaml", "yml": "yaml"}.get(path.rpartition(".")[2].lower(), "")
    return from_dict(parse(read_text(spark, path), kind))


def from_dict(doc: dict) -> Catalog:
    """Names are case-insensitive; ``nullable`` is false where it isn't given."""
    out = Catalog()
    for t in doc.get("tables", []):
        columns = [ColumnDef(c["name"], str(c.get("type", "")).upper(), c.get("length"), c.get("precision"), c.get("scale"), bool(c.get("nullable", False)), bool(c.get("primary_key", False)), bool(c.get("unique", False)), None if c.get("default") is None else str(c["default"]), (c["fk_table"], c["fk_column"]) if c.get("foreign_key") and c.get("fk_table") else None) for c in t.get("columns", [])]
        indexes = [(i["name"], tuple(i.get("columns", [])), bool(i.get("unique", False))) for i in t.get("indexes", [])]
        out.create_table(TableDef(t["name"], t.get("schema", ""), tuple(columns), (), tuple(indexes)))
    return out


def from_session(spark: SparkSession, tables: list[str]) -> Catalog:
    """Tables and views that the session knows."""
    out = Catalog()
    for name in tables:
        out.create_table(TableDef(name, "", tuple(ColumnDef(c.name, c.dataType.upper(), nullable=c.nullable) for c in spark.catalog.listColumns(name))))
    return out
