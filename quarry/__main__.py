"""Command line: analyse a statement or a file of them, a log, or follow a log.

    python -m quarry --sql "SELECT * FROM t" --dialect mysql
    python -m quarry --query workload.sql --output table
    python -m quarry --log server.log --output json
    python -m quarry --log server.log --watch --tail 20 --slow 0.5
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans import analysis
from quarry.session import session
from quarry.sources import config as configuration
from quarry.sources import logs, sinks, tail
from quarry.sources.schema_files import read_text
from quarry.sources.shared import checkpoint_folder
from quarry.streaming import alerts, monitor


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--sql", help="a statement")
    what.add_argument("--query", help="a file whose text is one statement")
    what.add_argument("--log", help="a query log")
    p.add_argument("--dialect", help="mysql, postgresql, sqlserver, sqlite or oracle")
    p.add_argument("--output", choices=("json", "table", "csv"), help="how results are shown")
    p.add_argument("--config", help="a JSON or YAML file of settings")
    p.add_argument("--watch", action="store_true", help="follow the log")
    p.add_argument("--tail", type=int, default=0, help="begin with the last N lines")
    p.add_argument("--slow", type=float, default=1.0, help="seconds from which a query is slow")
    return p.parse_args(argv)


def show(df: DataFrame, output: str) -> None:
    """As a table the first rows, for people; as JSON lines and CSV all rows, a partition at a time."""
    if output == "table":
        print(sinks.as_table(df))
        return
    if output == "json":
        for r in df.toJSON().toLocalIterator():
            print(r)
        return
    import csv

    out = csv.writer(sys.stdout)
    out.writerow(df.columns)
    for r in df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema)).toLocalIterator():
        out.writerow(r)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = session("quarry command line")
    settings = configuration.load(read_text(spark, a.config) if a.config else "")
    dialect, output = a.dialect or settings["parser"]["dialect"], a.output or settings["output"]["format"]
    if a.log and a.watch:
        lines = tail.follow(spark, a.log, from_end=not a.tail, lines=a.tail)
        manager = alerts.AlertManager([alerts.slow_query(a.slow), alerts.parse_error(), alerts.full_scan()])
        manager.handler(alerts.console)
        queries = monitor.processed(lines, dialect)
        running = [manager.start(queries, f"{checkpoint_folder(spark)}/watch-alerts-{spark.sparkContext.applicationId}"), monitor.report_every(monitor.statistics(queries, a.slow), f"{checkpoint_folder(spark)}/watch-stats-{spark.sparkContext.applicationId}")]
        try:
            spark.streams.awaitAnyTermination()
        except KeyboardInterrupt:
            for q in running:
                q.stop()
        return 0
    if a.log:
        f = settings["logger"]["filters"]
        entries = logs.filter_entries(logs.read(spark, a.log), f["min_duration_ms"], f["max_duration_ms"], exclude_system=f["exclude_system"])
        if f["query_types"]:
            entries = entries.where(logs.query_type(F.col("query")).isin(*f["query_types"]))
        for df in (entries, logs.metrics(entries), logs.by_type(entries)):
            show(df, output)
        return 0
    sql = a.sql or read_text(spark, a.query)
    if len(sql) > settings["parser"]["max_query_size"]:
        raise SystemExit("the statement is longer than parser.max_query_size")
    analyzed = analysis.analyze_frame(spark.createDataFrame([(1, dialect, sql)], "query_id long, dialect string, sql string"))
    found = analysis.advice(analyzed) if settings["analyzer"]["enable_optimizations"] else analysis.advice(analyzed).limit(0)
    if output == "json":
        print(sinks.report(analyzed, found).first().json)
    else:
        show(analyzed.drop("facts", "sql"), output)
        show(found, output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
