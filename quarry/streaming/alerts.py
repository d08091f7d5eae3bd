"""Alert rules: functions from processed queries to alerts, usable on batches and streams alike.

A processed query has timestamp, query, duration_s, error and the analysis columns. A rule is a condition, a level and
a message as column expressions; ``register`` adds one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlertRule:
    name: str
    when: Column
    level: Column
    message: Column


def slow_level(duration_s: Column, threshold: float) -> Column:
    """WARNING from the threshold, ERROR from twice, CRITICAL from five times it; null below."""
    return F.when(duration_s >= 5 * threshold, "CRITICAL").when(duration_s >= 2 * threshold, "ERROR").when(duration_s >= threshold, "WARNING")


def slow_query(threshold: float = 1.0) -> AlertRule:
    d = F.col("duration_s")
    return AlertRule("SLOW_QUERY", d >= threshold, slow_level(d, threshold), F.format_string("Query took %.3f s", d))


def parse_error() -> AlertRule:
    return AlertRule("PARSE_ERROR", F.col("error").isNotNull() & (F.coalesce("query", F.lit("")) != ""), F.lit("WARNING"), F.col("error"))


def full_scan() -> AlertRule:
    """SELECT, UPDATE or DELETE over whole tables."""
    kind, f = F.col("query_type"), F.col("facts")
    return AlertRule("FULL_SCAN", kind.isin("SELECT", "UPDATE", "DELETE") & ~f["has_where"] & (F.size("tables") > 0) & ~f["query_type"].startswith("WITH"), F.when(kind == "SELECT", "WARNING").otherwise("ERROR"), F.concat(kind, F.lit(" without WHERE")))


def optimization(severities: Column, minimum: str = "medium") -> AlertRule:
    """At least one piece of advice of the minimum severity: INFO is low, WARNING medium, CRITICAL and ERROR high."""
    wanted = {"low": ("INFO", "WARNING", "CRITICAL", "ERROR"), "medium": ("WARNING", "CRITICAL", "ERROR"), "high": ("CRITICAL", "ERROR")}[minimum]
    n = F.size(F.filter(severities, lambda s: s.isin(*wanted)))
    return AlertRule("OPTIMIZATION", n > 0, F.lit("INFO"), F.format_string("%d suggestions", n))


class AlertManager:
    def __init__(self, rules: list[AlertRule] | None = None):
        self.rules = list(rules if rules is not None else (slow_query(), parse_error(), full_scan()))
        self.handlers: list[Callable[[DataFrame, int], None]] = []

    def register(self, rule: AlertRule) -> None:
        self.rules.append(rule)

    def handler(self, fn: Callable[[DataFrame, int], None]) -> None:
        self.handlers.append(fn)

    def alerts(self, processed: DataFrame) -> DataFrame:
        """(level, type, message, query, timestamp, metadata): one explode, no shuffle, streams included."""
        each = F.array_compact(F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.struct(r.level.alias("level"), F.lit(r.name).alias("type"), r.message.alias("message"))) for r in self.rules)))
        meta = F.map_from_arrays(F.array(F.lit("duration_s"), F.lit("query_type")), F.array(F.coalesce(F.col("duration_s").cast("string"), F.lit("")), F.coalesce("query_type", F.lit(""))))
        return processed.select("query", "timestamp", meta.alias("metadata"), F.explode(each).alias("a")).select("a.*", "query", "timestamp", "metadata")

    def start(self, processed: DataFrame, checkpoint: str, trigger: dict | None = None):
        """A running query that hands each batch of alerts to the handlers."""

        def each(batch: DataFrame, n: int) -> None:
            for h in self.handlers:
                h(batch, n)

        return self.alerts(processed).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def console(batch: DataFrame, n: int) -> None:
    """Prints a batch's first alerts, queries cut to 100 characters."""
    batch.select("level", "type", "message", F.left("query", F.lit(100)).alias("query")).show(50, False)


def counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count("*").alias("n"))
