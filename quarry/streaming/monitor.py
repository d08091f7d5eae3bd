"""Live monitoring: lines to processed queries to statistics and windows, for streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.analysis import ANALYSIS, _analyzed
from quarry.sources.logs import extract_duration, extract_query, query_type


def processed(lines: DataFrame, dialect: str = "sqlserver", col: str = "value", now=None) -> DataFrame:
    """(timestamp, query, duration_s, sql, dialect, analysis columns) of each line that holds a statement. Stateless."""
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_extract(F.col(col), r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)", 1)), now if now is not None else F.current_timestamp())
    rows = lines.select(stamp.alias("timestamp"), extract_query(F.col(col)).alias("sql"), extract_duration(F.col(col)).alias("duration_s"), F.lit(dialect).alias("dialect")).where("sql IS NOT NULL")

    def run(batches):
        for b in batches:
            out = next(_analyzed(iter([b])))
            out.insert(0, "timestamp", b["timestamp"].to_numpy())
            out.insert(1, "duration_s", b["duration_s"].to_numpy())
            yield out

    return rows.mapInPandas(run, f"timestamp timestamp, duration_s double, sql string, dialect string, {ANALYSIS}").withColumnRenamed("sql", "query")


def statistics(queries: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Running totals: one row; on a stream, output mode ``complete``."""
    kind = query_type(F.col("query"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return queries.agg(F.count("*").alias("total"), n(F.col("duration_s") >= threshold).alias("slow"), *(n(kind == k).alias(k.lower() + "s") for k in ("SELECT", "INSERT", "UPDATE", "DELETE")), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("seconds"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and time window; a stream forgets a window when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with pauses under the gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def report_every(stats: DataFrame, checkpoint: str, seconds: int = 30):
    """Prints running totals at intervals."""
    return stats.writeStream.outputMode("complete").format("console").option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
