"""Results to JSON, CSV and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 1000


def write(df: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """A folder of part files, written by all tasks. CSV holds no nested columns: they go as JSON text."""
    if kind == "csv":
        flat = df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema))
        flat.write.mode(mode).csv(path, header=True)
    elif kind == "json":
        df.write.mode(mode).json(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(kind)


def report(analyzed: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One JSON document for each query: {analysis, suggestions}."""
    found = suggestions.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in suggestions.columns if c != "query_id")))).alias("suggestions"))
    rows = analyzed.join(found, "query_id", "left")
    return rows.select("query_id", F.to_json(F.struct(F.struct("query_type", "complexity", "tables", "columns", "joins", "conditions", "error").alias("analysis"), F.coalesce("suggestions", F.array().cast(found.schema["suggestions"].dataType)).alias("suggestions"))).alias("json"))


def as_table(df: DataFrame, rows: int = REPORT_ROWS, width: int = 50) -> str:
    """A fixed-width text of the first rows: a report for people."""
    return df._jdf.showString(rows, width, False)
