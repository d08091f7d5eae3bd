"""Queries of the workload side: logs, alerts, plans, streams, dialects; inline inputs where no table has them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dialects, shim
from quarry.operators import scripts
from quarry.plans import analysis, explain, validate
from quarry.session import load_tables, table
from quarry.sources import logs, schema_files
from quarry.sources.shared import scratch_folder
from quarry.streaming import alerts, monitor

LOG = (
    "2031-03-09 06:05:04.003 SQL:BatchCompleted SELECT title, shelf FROM books WHERE isbn = 9 Duration: 12 ms CPU: 3 ms Reads: 41 Writes: 0",
    "2031-03-09 06:59:59.950 SQL:BatchCompleted DELETE FROM loans WHERE due < '2030-01-01' Duration: 8020 ms CPU: 611 ms Reads: 90210 Writes: 377",
    "  2031-03-09 07:00:00.100 SQL:BatchCompleted SELECT COUNT(*) FROM members Duration: 333 ms CPU: 70 ms Reads: 5 Writes: 0",
    "2031-03-09 22:15:30.777 SQL:BatchCompleted INSERT INTO shelves (floor) VALUES (4) Duration: 1 ms CPU: 0 ms Reads: 2 Writes: 6",
    "",
    "no entry at all",
    "2024-01-01 11:40:00.12 spid51 DELETE FROM sessions",
    '<event name="sql_statement_completed" timestamp="2024-01-01T12:00:00Z" duration="42000" statement="SELECT 1 WHERE 1 &lt; 2" database_name="Sales">',
    '{"query_sql_text": "EXEC refresh", "avg_duration": 12.7, "avg_logical_io_reads": 3.9, "avg_logical_io_writes": 0.2}',
)
_SCHEMA = {"tables": [{"name": "users", "columns": [{"name": "id", "type": "INT", "primary_key": True}, {"name": "name", "type": "VARCHAR", "length": 100}, {"name": "email", "type": "VARCHAR", "length": 255, "unique": True}, {"name": "age", "type": "INT", "nullable": True}]}, {"name": "orders", "columns": [{"name": "id", "type": "INT", "primary_key": True}, {"name": "user_id", "type": "INT", "foreign_key": True, "fk_table": "users", "fk_column": "id"}, {"name": "total", "type": "DECIMAL", "precision": 10, "scale": 2}, {"name": "status", "type": "VARCHAR", "length": 20}, {"name": "shop_id", "type": "INT", "foreign_key": True, "fk_table": "shops", "fk_column": "id"}]}]}
_PG = '[{"Plan": {"Node Type": "Hash Join", "Total Cost": 12000.5, "Plan Rows": 20000, "Hash Cond": "(a.id = b.id)", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "a", "Total Cost": 1500, "Plan Rows": 50000, "Actual Rows": 1000}, {"Node Type": "Sort", "Total Cost": 900, "Plan Rows": 12000, "Plans": [{"Node Type": "Index Scan", "Relation Name": "b", "Index Name": "b_pk", "Total Cost": 8.3, "Plan Rows": 1}]}]}}]'
_PG2 = '[{"Plan": {"Node Type": "Nested Loop", "Total Cost": 800, "Plan Rows": 6000, "Plans": [{"Node Type": "Seq Scan", "Relation Name": "x", "Plan Rows": 90}, {"Node Type": "Seq Scan", "Relation Name": "y", "Plan Rows": 80}]}}]'
_MY = '{"query_block": {"cost_info": {"query_cost": "10.5"}, "table": {"table_name": "users", "access_type": "ALL", "rows_examined_per_scan": 500}}}'
PLANS = (("p1", "postgresql", _PG), ("p2", "postgresql", _PG2), ("p3", "mysql", _MY), ("p4", "postgresql", "not json"))


def _log(spark: SparkSession) -> DataFrame:
    return logs.parse_lines(spark.createDataFrame([(x,) for x in LOG], "value string"))


def _nodes(spark: SparkSession) -> DataFrame:
    return explain.plan_nodes(spark.createDataFrame(PLANS, "plan_id string, dialect string, plan string"))


def _analyzed(spark: SparkSession) -> DataFrame:
    return analysis.analyze_frame(analysis.workload(spark))


def _items(column: str, *fields: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _analyzed(spark).select("query_id", F.posexplode(column).alias("seq", "x")).select("query_id", F.col("seq").cast("long").alias("seq"), *(F.col(f"x.{f}").alias(f) for f in fields))

    return run


def wl_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed(spark).select("query_id", "query_type", F.col("complexity").cast("long").alias("complexity"), F.col("error").isNotNull().alias("failed"))


def wl_tokens(spark: SparkSession, d: str) -> DataFrame:
    return analysis.token_frame(analysis.workload(spark)).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("literal")).alias("chars"))


def wl_advice(spark: SparkSession, d: str) -> DataFrame:
    return analysis.advice(_analyzed(spark)).select("query_id", "rule", "type", "severity", "category", "impact", "subject")


def wl_basic(spark: SparkSession, d: str) -> DataFrame:
    return analysis.basic_suggestions(_analyzed(spark))


def wl_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(_analyzed(spark), schema_files.from_dict(_SCHEMA).columns_frame(spark)).select("query_id", "type", "table", "column")


TYPED = ((1, "mysql", "SELECT id FROM users WHERE name = 5 AND age IN (1, 'x')"), (2, "mysql", "INSERT INTO users (id, name) VALUES ('a', 'b'), (1)"), (3, "mysql", "UPDATE users SET age = 'x' WHERE id + 1"), (4, "mysql", "SELECT id FROM users u WHERE u.age IS NULL OR u.name = 'x' AND age > 3"))


def wl_types(spark: SparkSession, d: str) -> DataFrame:
    return validate.check_types(spark.createDataFrame(TYPED, "query_id bigint, dialect string, sql string"), schema_files.from_dict(_SCHEMA).columns_frame(spark)).select("query_id", "type", "column")


def schema_fk(spark: SparkSession, d: str) -> DataFrame:
    return schema_files.from_dict(_SCHEMA).broken_foreign_keys(spark)


def dialect_features(spark: SparkSession, d: str) -> DataFrame:
    return dialects.feature_matrix(spark).where("supported").groupBy("dialect").agg(F.count("*").alias("n"))


def dialect_quotes(spark: SparkSession, d: str) -> DataFrame:
    return dialects.feature_matrix(spark).select("dialect").distinct().select("dialect", dialects.quoted(F.lit("a b"), F.col("dialect")).alias("q"))


def dialect_shim(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    parts = [("sqlserver", "SELECT TOP 3 [o].[o_orderkey] AS [k] FROM [orders] [o] WITH (NOLOCK) ORDER BY [o].[o_orderkey]"), ("oracle", 'SELECT "O_ORDERKEY" AS k FROM orders WHERE ROWNUM <= 2 AND o_orderkey = NVL(NULL, 7)'), ("mysql", "SELECT `o_orderkey` AS k FROM `orders` WHERE `o_orderstatus` = \"F\" ORDER BY k LIMIT 2, 3"), ("postgresql", 'SELECT "o_orderkey" AS k FROM orders WHERE o_orderstatus = $$P$$ ORDER BY 1 FETCH FIRST 4 ROWS ONLY')]
    out = None
    for name, sql in parts:
        part = spark.sql(shim.to_spark(sql, name)).select(F.lit(name).alias("dialect"), "k")
        out = part if out is None else out.unionByName(part)
    return out


#: Statements with TOP and ROWNUM where a limit at the end would give something else.
LIMITS = (
    ("rownum count", "oracle", "SELECT COUNT(*) AS k FROM orders WHERE ROWNUM <= 10"),
    ("rownum order", "oracle", "SELECT COUNT(k) AS k FROM (SELECT o.o_orderkey AS k FROM orders o WHERE o.o_orderkey < 9 AND ROWNUM < 4 ORDER BY o.o_orderkey DESC)"),
    ("rownum top-k", "oracle", "SELECT MAX(k) AS k FROM (SELECT k FROM (SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey) WHERE ROWNUM <= 5)"),
    ("top in arms", "sqlserver", "SELECT COUNT(*) AS k FROM (SELECT TOP 3 o_orderkey AS k FROM orders UNION ALL SELECT TOP (2) c_custkey FROM customer) t"),
    ("top in one arm", "sqlserver", "SELECT COUNT(*) AS k FROM (SELECT TOP 3 r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation) t"),
    ("top with ties", "sqlserver", "SELECT SUM(n_nationkey) AS k FROM (SELECT TOP 2 WITH TIES n_nationkey FROM nation ORDER BY n_regionkey) t"),
)


def dialect_limits(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    parts = [spark.sql(shim.to_spark(sql, dialect)).select(F.lit(name).alias("name"), F.col("k").cast("long").alias("k")) for name, dialect, sql in LIMITS]
    return functools.reduce(DataFrame.unionByName, parts)


#: Files of statements, with blocks, strings and comments that hold the separator.
FILES = (
    ("a.sql", "mysql", "CREATE TABLE t (a INT); -- one; two\nINSERT INTO t VALUES (';');\nCREATE TRIGGER g AFTER INSERT ON t FOR EACH ROW BEGIN UPDATE t SET a = CASE WHEN a > 1 THEN 2 ELSE 3 END; DELETE FROM t; END;\nSELECT a FROM t"),
    ("b.sql", "sqlserver", "BEGIN TRANSACTION;\nUPDATE t SET a = 1;\nCOMMIT;\nGO\nSELECT a FROM t\nGO\n"),
    ("c.sql", "postgresql", "CREATE FUNCTION f() RETURNS INT AS $$ BEGIN RETURN 1; END; $$ LANGUAGE plpgsql; SELECT f();;"),
    ("d.sql", "oracle", "DECLARE x NUMBER; BEGIN x := 1; IF x > 0 THEN x := 2; END IF; END;\n/\nSELECT 1 FROM dual;"),
    ("e.sql", "mysql", None),
)


def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame(FILES, "path string, dialect string, text string")
    return scripts.statements(files).select("path", "seq", F.length("sql").alias("chars"), F.element_at(F.split("sql", " "), 1).alias("first"))


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark).select("format", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "duration_ms", "database", "query", "logical_reads", "writes", "cpu_ms", F.col("spid").cast("long").alias("spid"))


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    return logs.metrics(_log(spark))


def log_by_type(spark: SparkSession, d: str) -> DataFrame:
    return logs.by_type(_log(spark))


def log_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return logs.by_hour(_log(spark))


def log_filter(spark: SparkSession, d: str) -> DataFrame:
    return logs.filter_entries(_log(spark), min_duration=60, query_type_prefix="select", max_reads=20000).select("query", "duration_ms")


def alert_slow_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") / 20).alias("s"))
    return e.select("event_id", alerts.slow_level(F.col("s"), 1.0).alias("level")).where("level IS NOT NULL")


def alert_counts(spark: SparkSession, d: str) -> DataFrame:
    q = analysis.analyze_frame(analysis.workload(spark)).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("duration_s", F.col("query_id") / 2.0).withColumnRenamed("sql", "query")
    return alerts.counts(alerts.AlertManager().alerts(q))


def plan_stats(spark: SparkSession, d: str) -> DataFrame:
    return explain.statistics(_nodes(spark)).select("plan_id", "nodes", "scans", "full_scans", "joins", "index_scans", "est_rows", "depth")


def plan_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return explain.bottlenecks(_nodes(spark)).select("plan_id", F.col("node_id").cast("long").alias("node_id"), "issue", "severity", F.round("impact", 4).alias("impact"))


def plan_issues(spark: SparkSession, d: str) -> DataFrame:
    return explain.issues(_nodes(spark)).select("plan_id", F.col("node_id").cast("long").alias("node_id"), "issue", "severity", "priority")


def plan_score(spark: SparkSession, d: str) -> DataFrame:
    return explain.scores(_nodes(spark)).select("plan_id", F.round("score", 4).alias("score"))


def plan_spark(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    df = spark.sql("SELECT c_name, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name")
    return explain.statistics(explain.plan_nodes(explain.spark_plan(df))).select("full_scans", "joins")


def _stream(spark: SparkSession, d: str, build, mode: str) -> DataFrame:
    """All that a streaming query over ``events`` gives for its files: run once; each batch's whole result (mode
    ``complete``) replaces the last one's in the shared folder, from which it is read back."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*")
    stream = source.parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else d)
    folder = scratch_folder(spark, "stream")
    result = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    store = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/result")
    writer.foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/result")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") >= 50).cast("long")).alias("slow")), "complete")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: monitor.tumbling(e), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "cents")


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: monitor.sessions(e), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


QUERIES = {
    "wl_complexity": wl_complexity, "wl_tokens": wl_tokens, "wl_tables": _items("tables", "name", "alias", "usage"), "wl_columns": _items("columns", "table", "name", "usage"), "wl_joins": _items("joins", "type", "left_table", "right_table", "condition"), "wl_conditions": _items("conditions", "table", "column", "operator", "value"),
    "wl_advice": wl_advice, "wl_basic_suggestions": wl_basic, "wl_validation": wl_validation, "wl_types": wl_types, "schema_fk_integrity": schema_fk, "dialect_features": dialect_features, "dialect_quotes": dialect_quotes, "dialect_shim": dialect_shim, "dialect_limits": dialect_limits, "sql_statements": sql_statements,
    "log_entries": log_entries, "log_metrics": log_metrics, "log_by_type": log_by_type, "log_by_hour": log_by_hour, "log_filter": log_filter, "alert_slow_query": alert_slow_query, "alert_counts": alert_counts,
    "plan_stats": plan_stats, "plan_bottlenecks": plan_bottlenecks, "plan_issues": plan_issues, "plan_score": plan_score, "plan_spark": plan_spark, "stream_stats": stream_stats, "stream_tumbling": stream_tumbling, "stream_session": stream_session,
}

ORACLES: dict[str, str] = {
    "alert_slow_query": "SELECT event_id, CASE WHEN value / 20 >= 5 THEN 'CRITICAL' WHEN value / 20 >= 2 THEN 'ERROR' ELSE 'WARNING' END AS level FROM events WHERE value / 20 >= 1",
    "stream_stats": "SELECT event_type, COUNT(*) AS n, CAST(SUM(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS slow FROM events GROUP BY event_type",
    "stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "stream_session": "SELECT user_id, CAST(SUM(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions, COUNT(*) AS n FROM (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) t GROUP BY user_id",
    "log_metrics": "SELECT CAST(7 AS BIGINT) AS total, 8420 / 7.0 AS avg_ms, 0 AS min_ms, 8020 AS max_ms, 90261 AS reads, 383 AS writes",
    "log_by_type": "SELECT * FROM (VALUES ('DELETE', 2), ('SELECT', 3), ('INSERT', 1), ('EXECUTE', 1)) t(query_type, n)",
    "log_by_hour": "SELECT * FROM (VALUES (11, 1), (22, 1), (6, 2), (7, 1), (12, 1)) t(hour, n)",
    "dialect_features": "SELECT * FROM (VALUES ('mysql', 6), ('postgresql', 10), ('sqlserver', 5), ('sqlite', 6), ('oracle', 6)) t(dialect, n)",
    "dialect_quotes": "SELECT * FROM (VALUES ('mysql', '`a b`'), ('postgresql', '\"a b\"'), ('sqlserver', '[a b]'), ('sqlite', '\"a b\"'), ('oracle', '\"a b\"')) t(dialect, q)",
    "dialect_shim": "SELECT * FROM (SELECT 'sqlserver' AS dialect, o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL SELECT 'oracle', o_orderkey FROM orders WHERE o_orderkey = 7 UNION ALL SELECT * FROM (SELECT 'mysql', o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 2 LIMIT 3 OFFSET 2) UNION ALL SELECT * FROM (SELECT 'postgresql', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY 2 LIMIT 4)",
    "dialect_limits": "SELECT 'rownum count' AS name, least(10, count(*)) AS k FROM orders UNION ALL SELECT 'rownum order', least(3, count(*)) FROM orders WHERE o_orderkey < 9 UNION ALL SELECT 'rownum top-k', max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5) a UNION ALL SELECT 'top in arms', 5 UNION ALL SELECT 'top in one arm', 3 + count(*) FROM nation UNION ALL SELECT 'top with ties', sum(n_nationkey) FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation)",
    "sql_statements": "SELECT * FROM (VALUES ('a.sql', 0, 22, 'CREATE'), ('a.sql', 1, 26, 'INSERT'), ('a.sql', 2, 124, 'CREATE'), ('a.sql', 3, 15, 'SELECT'), ('b.sql', 0, 17, 'BEGIN'), ('b.sql', 1, 18, 'UPDATE'), ('b.sql', 2, 6, 'COMMIT'), ('b.sql', 3, 15, 'SELECT'), ('c.sql', 0, 78, 'CREATE'), ('c.sql', 1, 10, 'SELECT'), ('d.sql', 0, 65, 'DECLARE'), ('d.sql', 1, 18, 'SELECT')) t(path, seq, chars, first)",
    "schema_fk_integrity": "SELECT 'orders' AS \"table\", 'shop_id' AS \"column\", 'shops' AS ref_table, 'id' AS ref_column",
    "wl_types": "SELECT * FROM (VALUES (1, 'TYPE_MISMATCH', NULL), (1, 'TYPE_MISMATCH', NULL), (2, 'TYPE_MISMATCH', 'id'), (2, 'COLUMN_COUNT_MISMATCH', NULL), (3, 'TYPE_MISMATCH', 'age'), (3, 'NON_BOOLEAN_EXPRESSION', NULL)) t(query_id, type, \"column\")",
    "wl_basic_suggestions": "SELECT * FROM (VALUES (1, 'SELECT_ALL', 'WARNING'), (2, 'CARTESIAN_PRODUCT', 'ERROR'), (6, 'SELECT_ALL', 'WARNING')) t(query_id, type, severity)",
    "wl_joins": "SELECT * FROM (VALUES (8, 0, 'INNER', 'u', 'o', '(u.id = o.user_id)'), (8, 1, 'LEFT', 'o', 'p', '(o.product_id = p.id)'), (8, 2, 'INNER', 'p', 's', '(s.product_id = p.id)')) t(query_id, seq, type, left_table, right_table, condition)",
    "wl_validation": "SELECT * FROM (VALUES (1, 'TABLE_NOT_FOUND', 'loans', NULL), (2, 'TABLE_NOT_FOUND', 'books', NULL), (2, 'TABLE_NOT_FOUND', 'members', NULL), (3, 'TABLE_NOT_FOUND', 'books', NULL), (4, 'TABLE_NOT_FOUND', 'loans', NULL), (5, 'TABLE_NOT_FOUND', 'books', NULL), (5, 'TABLE_NOT_FOUND', 'loans', NULL), (6, 'TABLE_NOT_FOUND', 'books', NULL), (6, 'TABLE_NOT_FOUND', 'shelves', NULL), (8, 'TABLE_NOT_FOUND', 'products', NULL), (8, 'TABLE_NOT_FOUND', 'stock', NULL), (8, 'COLUMN_NOT_FOUND', 'orders', 'product_id'), (14, 'COLUMN_NOT_FOUND', NULL, 'data')) t(query_id, type, \"table\", \"column\")",
    "wl_complexity": "SELECT * FROM (VALUES (2, 'SELECT', 5, FALSE), (3, 'SELECT', 4, FALSE), (5, 'SELECT', 5, FALSE), (6, 'SELECT', 4, FALSE), (1, 'SELECT', 1, FALSE), (4, 'SELECT', 2, FALSE), (7, 'SELECT', 3, FALSE), (8, 'SELECT', 13, FALSE), (9, 'UPDATE', 2, FALSE), (10, 'DELETE', 3, FALSE), (11, 'SELECT', 3, FALSE), (12, 'INSERT', 1, FALSE), (13, NULL, NULL, TRUE), (14, 'SELECT', 3, FALSE), (15, 'SELECT', 2, FALSE)) t(query_id, query_type, complexity, failed)",
    "wl_conditions": "SELECT * FROM (VALUES (3, 0, '', 'pages', '>', '300'), (5, 0, 'l', 'due', 'IS', 'NULL'), (6, 0, 's', 'floor', '=', '2'), (7, 0, 'u', 'age', 'BETWEEN', '18 AND 65'), (8, 0, 'o', 'status', '=', 'done'), (9, 0, '', 'id', '=', '3'), (10, 0, '', 'status', '=', 'old'), (10, 1, '', 'total', '<', '5'), (11, 0, '', 'age', '>', '30'), (14, 0, '', 'id', 'IN', '1, 2, 3, 4, 5, 6, 7')) t(query_id, seq, \"table\", \"column\", operator, value)",
    "plan_stats": "SELECT * FROM (VALUES ('p1', 4, 2, 1, 1, 1, 82001, 3), ('p2', 3, 2, 2, 1, 0, 6170, 2), ('p3', 1, 1, 1, 0, 0, 500, 1), ('p4', 1, 0, 0, 0, 0, 0, 1)) t(plan_id, nodes, scans, full_scans, joins, index_scans, est_rows, depth)",
    "plan_bottlenecks": "SELECT * FROM (VALUES ('p1', 0, 'EXPENSIVE_OPERATION', 'WARNING', 12.0005), ('p1', 1, 'FULL_SCAN', 'WARNING', 50.0), ('p1', 1, 'EXPENSIVE_OPERATION', 'WARNING', 1.5), ('p1', 1, 'BAD_ESTIMATE', 'INFO', 0.02)) t(plan_id, node_id, issue, severity, impact)",
    "plan_issues": "SELECT * FROM (VALUES ('p1', 1, 'MISSING_INDEX', 'WARNING', 'CRITICAL'), ('p1', 2, 'EXPENSIVE_SORT', 'INFO', 'MEDIUM'), ('p2', 0, 'INEFFICIENT_JOIN', 'WARNING', 'HIGH'), ('p2', 0, 'CARTESIAN_PRODUCT', 'CRITICAL', 'CRITICAL'), ('p3', 0, 'MISSING_INDEX', 'WARNING', 'HIGH')) t(plan_id, node_id, issue, severity, priority)",
    "plan_score": "SELECT * FROM (VALUES ('p1', 35.0), ('p2', 56.6667), ('p3', 70.0), ('p4', 100.0)) t(plan_id, score)",
    "plan_spark": "SELECT 2 AS full_scans, 1 AS joins",
    "log_filter": "SELECT * FROM (VALUES ('SELECT COUNT(*) FROM members', 333)) t(query, duration_ms)",
    # Worked out by hand from the rules, for the inline inputs above.
    "wl_tables": "SELECT * FROM (VALUES (1, 0, 'loans', '', 'SELECT'), (2, 0, 'books', 'b', 'SELECT'), (2, 1, 'members', 'm', 'SELECT'), (3, 0, 'books', '', 'SELECT'), (4, 0, 'loans', '', 'SELECT'), (5, 0, 'books', '', 'SELECT'), (5, 1, 'loans', 'l', 'SELECT'), (6, 0, 'shelves', 's', 'SELECT'), (6, 1, 'books', 'b', 'SELECT'), (7, 0, 'users', 'u', 'SELECT'), (8, 0, 'users', 'u', 'SELECT'), (8, 1, 'orders', 'o', 'SELECT'), (8, 2, 'products', 'p', 'SELECT'), (8, 3, 'stock', 's', 'SELECT'), (9, 0, 'users', '', 'UPDATE'), (10, 0, 'orders', '', 'DELETE'), (11, 0, 'users', '', 'SELECT'), (12, 0, 'orders', '', 'INSERT'), (14, 0, 'users', '', 'SELECT'), (15, 0, 'users', '', 'SELECT')) t(query_id, seq, name, alias, usage)",
    "wl_columns": "SELECT * FROM (VALUES (1, 0, '', 'due', 'ORDER_BY'), (2, 0, 'b', 'title', 'SELECT'), (2, 1, 'm', 'city', 'SELECT'), (2, 2, 'b', 'shelf', 'SELECT'), (3, 0, '', 'isbn', 'SELECT'), (3, 1, '', 'title', 'SELECT'), (3, 2, '', 'title', 'WHERE'), (3, 3, '', 'pages', 'WHERE'), (4, 0, '', 'title', 'SELECT'), (4, 1, '', 'title', 'GROUP_BY'), (5, 0, '', 'title', 'SELECT'), (5, 1, 'l', 'isbn', 'SELECT'), (5, 2, 'l', 'due', 'WHERE'), (5, 3, '', 'isbn', 'WHERE'), (6, 0, 'b', 'isbn', 'SELECT'), (6, 1, 'b', 'title', 'WHERE'), (6, 2, 's', 'floor', 'WHERE'), (7, 0, 'u', 'name', 'SELECT'), (7, 1, 'u', 'age', 'WHERE'), (8, 0, 'u', 'id', 'JOIN'), (8, 1, 'o', 'user_id', 'JOIN'), (8, 2, 'o', 'product_id', 'JOIN'), (8, 3, 'p', 'id', 'JOIN'), (8, 4, 's', 'product_id', 'JOIN'), (8, 5, 'p', 'id', 'JOIN'), (8, 6, 'u', 'name', 'SELECT'), (8, 7, 'o', 'total', 'SELECT'), (8, 8, 'o', 'status', 'WHERE'), (8, 9, 'u', 'name', 'GROUP_BY'), (8, 10, 'o', 'total', 'HAVING'), (8, 11, '', 'spent', 'ORDER_BY'), (9, 0, 'users', 'name', 'UPDATE'), (9, 1, '', 'id', 'WHERE'), (10, 0, '', 'status', 'WHERE'), (10, 1, '', 'total', 'WHERE'), (11, 0, '', 'id', 'SELECT'), (11, 1, '', 'age', 'WHERE'), (12, 0, 'orders', 'user_id', 'INSERT'), (12, 1, 'orders', 'total', 'INSERT'), (14, 0, '', 'id', 'SELECT'), (14, 1, '', 'name', 'WHERE'), (14, 2, '', 'data', 'WHERE'), (14, 3, '', 'id', 'WHERE'), (15, 0, '', 'name', 'SELECT'), (15, 1, '', 'name', 'ORDER_BY')) t(query_id, seq, \"table\", name, usage)",
    "wl_advice": "SELECT * FROM (VALUES (3, 'FUNCTION_IN_WHERE', 'FUNCTION_IN_WHERE', 'WARNING', 'PERFORMANCE', 'MEDIUM', 'TRIM'), (6, 'FUNCTION_IN_WHERE', 'FUNCTION_IN_WHERE', 'WARNING', 'PERFORMANCE', 'MEDIUM', 'LOWER'), (1, 'MISSING_WHERE', 'MISSING_WHERE', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (1, 'OVERPRIVILEGED_SELECT', 'OVERPRIVILEGED_SELECT', 'WARNING', 'SECURITY', 'MEDIUM', NULL), (1, 'SELECT_STAR', 'SELECT_STAR', 'WARNING', 'PERFORMANCE', 'MEDIUM', NULL), (2, 'CARTESIAN_PRODUCT', 'CARTESIAN_PRODUCT', 'CRITICAL', 'PERFORMANCE', 'HIGH', NULL), (2, 'MISSING_WHERE', 'MISSING_WHERE', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (3, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (4, 'MISSING_WHERE', 'MISSING_WHERE', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (4, 'MYSQL_LIMIT_OPTIMIZATION', 'MYSQL_LIMIT_WITHOUT_ORDER', 'WARNING', 'PERFORMANCE', 'MEDIUM', NULL), (5, 'INEFFICIENT_SUBQUERY', 'INEFFICIENT_SUBQUERY', 'INFO', 'PERFORMANCE', 'MEDIUM', NULL), (6, 'CARTESIAN_PRODUCT', 'CARTESIAN_PRODUCT', 'CRITICAL', 'PERFORMANCE', 'HIGH', NULL), (6, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (6, 'SELECT_STAR', 'SELECT_STAR', 'WARNING', 'PERFORMANCE', 'MEDIUM', NULL), (7, 'SQLSERVER_NOLOCK_WARNING', 'SQLSERVER_NOLOCK_WARNING', 'WARNING', 'SECURITY', 'HIGH', NULL), (7, 'UNNECESSARY_DISTINCT', 'UNNECESSARY_DISTINCT', 'INFO', 'PERFORMANCE', 'LOW', NULL), (8, 'INEFFICIENT_JOIN_ORDER', 'JOIN_ORDER', 'INFO', 'PERFORMANCE', 'MEDIUM', NULL), (8, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', 'orders'), (8, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', 'products'), (8, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', 'stock'), (8, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (8, 'ORACLE_HINT_OPTIMIZATION', 'ORACLE_HINT_SUGGESTION', 'INFO', 'PERFORMANCE', 'MEDIUM', NULL), (14, 'MISSING_INDEX_HINT', 'INDEX_SUGGESTION', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (14, 'POSTGRESQL_ARRAY_OPTIMIZATION', 'POSTGRESQL_ARRAY_USAGE', 'INFO', 'PERFORMANCE', 'MEDIUM', NULL), (14, 'POSTGRESQL_JSON_OPTIMIZATION', 'POSTGRESQL_JSON_TYPE', 'INFO', 'PERFORMANCE', 'MEDIUM', NULL), (14, 'SQL_INJECTION_RISK', 'SQL_INJECTION_RISK', 'CRITICAL', 'SECURITY', 'HIGH', NULL), (15, 'MISSING_WHERE', 'MISSING_WHERE', 'INFO', 'PERFORMANCE', 'HIGH', NULL), (15, 'SQLSERVER_TOP_OPTIMIZATION', 'SQLSERVER_TOP_VS_LIMIT', 'WARNING', 'PERFORMANCE', 'LOW', NULL)) t(query_id, rule, type, severity, category, impact, subject)",
    "alert_counts": "SELECT * FROM (VALUES ('CRITICAL', 6), ('ERROR', 6), ('WARNING', 7)) t(level, n)",
    "log_entries": "SELECT * FROM (VALUES ('Profiler', '2031-03-09 06:05:04.003', 12, NULL, 'SELECT title, shelf FROM books WHERE isbn = 9', 41, 0, 3, NULL), ('Profiler', '2031-03-09 06:59:59.950', 8020, NULL, 'DELETE FROM loans WHERE due < ''2030-01-01''', 90210, 377, 611, NULL), ('Profiler', '2031-03-09 07:00:00.100', 333, NULL, 'SELECT COUNT(*) FROM members', 5, 0, 70, NULL), ('Profiler', '2031-03-09 22:15:30.777', 1, NULL, 'INSERT INTO shelves (floor) VALUES (4)', 2, 6, 0, NULL), ('ErrorLog', '2024-01-01 11:40:00.120', 0, NULL, 'DELETE FROM sessions', 0, 0, 0, 51), ('ExtendedEvents', '2024-01-01 12:00:00.000', 42, 'Sales', 'SELECT 1 WHERE 1 < 2', 0, 0, 0, NULL), ('QueryStore', NULL, 12, NULL, 'EXEC refresh', 3, 0, 0, NULL)) t(format, \"at\", duration_ms, database, query, logical_reads, writes, cpu_ms, spid)",
    "wl_tokens": "SELECT * FROM (VALUES (1, 7, 26), (2, 18, 47), (3, 17, 55), (4, 16, 51), (5, 22, 71), (6, 29, 71), (7, 20, 66), (8, 74, 202), (9, 10, 29), (10, 11, 41), (11, 20, 56), (12, 20, 50), (13, 3, 15), (14, 34, 64), (15, 9, 36)) t(query_id, n, chars)",
}
