"""Session and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The tables that relational queries read.
STAR = (*TABLES[:8], "embeddings")


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; the cluster's own settings come first."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = STAR) -> None:
    """Temporary views over the Parquet tables; only what a query names is ever scanned."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
