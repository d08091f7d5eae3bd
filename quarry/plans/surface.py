"""Queries of files, sinks, declared tables and the rest of the workload side.

Files are written to the folder that driver and executors share, and read back from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dialects, shim
from quarry.operators import catalog
from quarry.plans import analysis, explain
from quarry.plans.monitoring import LOG, _stream
from quarry.session import load_tables, table
from quarry.sources import config, logs, schema_files, sinks, tail
from quarry.sources.shared import scratch_folder
from quarry.streaming import alerts, monitor


def _file(spark: SparkSession, name: str, lines: list[str]) -> str:
    """The path of one text file with the lines in order."""
    folder = scratch_folder(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


# --- files and logs ------------------------------------------------------------------------------

def detect_format(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate([*LOG, "CPU: 9 ms", "Login succeeded for user"])), "seq long, value string")
    return lines.select("seq", logs.detect_format(F.col("value")).alias("format"))


def log_file(spark: SparkSession, d: str) -> DataFrame:
    return logs.read(spark, _file(spark, "log", list(LOG))).select("format", "query", "duration_ms")


def log_by_database(spark: SparkSession, d: str) -> DataFrame:
    return logs.by_database(logs.parse_lines(spark.createDataFrame([(x,) for x in LOG], "value string")))


def last_lines(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_lines(spark, _file(spark, "last", [f"line {k}" if k % 5 else "" for k in range(1, 5001)]), 7)


#: Lines of three servers, a bare statement, and lines without one.
LIVE = (
    (1, "2031-05-06T07:08:09.123456Z\t   44 Query\tSELECT title FROM books"),
    (2, "2031-05-06 07:08:09 UTC [77] LOG:  duration: 1250.5 ms  statement: DELETE FROM loans WHERE id = 4"),
    (3, "2031-05-06 07:08:09 spid60 exec dbo.refresh_shelves 3"),
    (4, "  update members set city = 'Rome' where id = 9"),
    (5, "# Query_time: 2.75  Lock_time: 0.0"),
    (6, "checkpoint starting: time"),
    (7, ""),
)


def live_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(LIVE, "seq long, value string")
    return lines.select("seq", logs.extract_query(F.col("value")).alias("query"), logs.extract_duration(F.col("value")).alias("seconds"))


def tail_stream(spark: SparkSession, d: str) -> DataFrame:
    """A followed file: each batch is appended to the shared folder. The file is opened by path on driver and executors."""
    names = [f"SELECT {k} FROM t{k % 7}" for k in range(2000)]
    file = spark.read.text(_file(spark, "tail", names)).inputFiles()[0].removeprefix("file://")
    out = scratch_folder(spark, "tailed")
    store = lambda batch, _: batch.write.mode("append").parquet(f"{out}/lines")
    query = tail.follow(spark, file, lines=500).writeStream.foreachBatch(store).option("checkpointLocation", f"{out}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    lines = spark.read.schema("value string, pos long").parquet(f"{out}/lines")
    return lines.groupBy(F.element_at(F.split("value", " "), -1).alias("target")).agg(F.count("*").alias("n"), F.countDistinct("pos").alias("places"))


SCHEMA_JSON = '{"tables": [{"name": "Books", "columns": [{"name": "Isbn", "type": "bigint", "primary_key": true}, {"name": "title", "type": "varchar", "length": 80, "nullable": true}]}]}'
SCHEMA_YAML = "tables:\n- name: loans\n  columns:\n  - {name: id, type: int, primary_key: true}\n  - {name: isbn, type: bigint, fk_table: books, fk_column: isbn, foreign_key: true}\n  - {name: fee, type: decimal, precision: 8, scale: 2, nullable: true, default: 0}\n"


def schema_documents(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for text, kind in ((SCHEMA_JSON, "json"), (SCHEMA_YAML, "yaml")):
        path = _file(spark, f"schema_{kind}", text.split("\n"))
        read = schema_files.from_dict(schema_files.parse(schema_files.read_text(spark, path), kind)).columns_frame(spark)
        out = read if out is None else out.unionByName(read)
    return out.select("table", "column", "type", "length", "precision", "scale", "nullable", "is_pk", "default")


def configuration(spark: SparkSession, d: str) -> DataFrame:
    """What a document leaves as it was and what it sets; a wrong one is an error."""
    path = _file(spark, "config", ["parser:", "  dialect: mysql", "logger:", "  filters:", "    min_duration_ms: 250"])
    c = config.load(schema_files.read_text(spark, path), "yaml")
    rows = [("parser.dialect", c["parser"]["dialect"]), ("parser.max_query_size", str(c["parser"]["max_query_size"])), ("logger.filters.min_duration_ms", str(c["logger"]["filters"]["min_duration_ms"])), ("output.format", c["output"]["format"])]
    try:
        config.load('{"analyzer": {"complexity_threshold": -1}}')
    except ValueError:
        rows.append(("analyzer.complexity_threshold", "refused"))
    return spark.createDataFrame(rows, "name string, value string")


# --- sinks ---------------------------------------------------------------------------------------

def _sink(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
        path = scratch_folder(spark, f"sink_{kind}")
        sinks.write(o, path, kind)
        reader = spark.read.schema(o.schema)
        return reader.csv(path, header=True) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)

    return run


def sink_csv_nested(spark: SparkSession, d: str) -> DataFrame:
    """CSV has no arrays: they go as JSON text."""
    path = scratch_folder(spark, "sink_nested")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    sinks.write(lines, path, "csv")
    return spark.read.schema("l_orderkey bigint, lines string").csv(path, header=True)


# --- declared tables -----------------------------------------------------------------------------

def ddl_tables(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE, INSERT, ALTER, CREATE TABLE AS, DROP; the dropped tables' data stays, since they are external."""
    load_tables(spark, d, ("nation", "region"))
    first, second, folder = f"q_{uuid.uuid4().hex}", f"q_{uuid.uuid4().hex}", scratch_folder(spark, "ddl")
    spark.sql(f"CREATE TABLE {first} (k INT, name STRING, region INT) USING parquet LOCATION '{folder}/a'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {first} (other INT) USING parquet")
    spark.sql(f"INSERT INTO {first} SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20")
    spark.sql(f"ALTER TABLE {first} ADD COLUMNS (note STRING)")
    spark.sql(f"INSERT INTO {first} SELECT n_nationkey, n_name, n_regionkey, 'late' FROM nation WHERE n_nationkey >= 20")
    spark.sql(f"CREATE TABLE {second} USING parquet LOCATION '{folder}/b' AS SELECT t.k, t.name, t.note, r_name FROM {first} t JOIN region ON region = r_regionkey")
    schema = spark.table(second).schema
    for name in (first, second):
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.schema(schema).parquet(f"{folder}/b")


def ddl_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Declarations alone: tables, columns, indexes, and what is left after drops."""
    c = catalog.Catalog()
    c.create_table(catalog.TableDef("Books", "", (catalog.ColumnDef("isbn", "bigint", primary_key=True), catalog.ColumnDef("title", "varchar", 80))))
    c.create_table(catalog.TableDef("loans", "", (catalog.ColumnDef("id", "int"),)))
    c.create_table(catalog.TableDef("books"), if_not_exists=True)
    c.add_column("books", catalog.ColumnDef("pages", "int", nullable=True))
    c.drop_column("BOOKS", "TITLE")
    c.create_index("by_pages", "books", ["pages"])
    c.create_index("by_isbn", "books", ["isbn", "pages"], unique=True)
    c.drop("index", "by_pages")
    c.drop("table", "loans")
    c.drop("table", "loans", if_exists=True)
    columns = c.columns_frame(spark).select(F.lit("column").alias("kind"), F.col("column").alias("name"), "type")
    indexes = [("index", name, ",".join(on) + (" unique" if unique else "")) for t in c.tables.values() for name, on, unique in t.indexes]
    return columns.unionByName(spark.createDataFrame(indexes, columns.schema))


def null_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("who"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderkey")
    return catalog.not_null_violations(o, ["who", "status", "o_orderkey"])


# --- dialects ------------------------------------------------------------------------------------

def reserved(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(w,) for w in ("ilike", "Select", "zerofill", "view", "top", "rownum", "users", "pragma")], "name string")
    words = F.broadcast(dialects.reserved_words(spark))
    return names.join(words, F.upper("name") == F.col("word")).select("dialect", "word")


def registry(spark: SparkSession, d: str) -> DataFrame:
    asked = ("MySQL", "postgres", "mssql", "sqlite", "ORACLE", "unheard of", "")
    return spark.createDataFrame([(a, dialects.get(a).name, dialects.get(a).limit) for a in asked], "asked string, name string, limit_syntax string")


def shim_functions(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d, ("nation", "orders"))
    sql = "SELECT [o_orderkey] AS k, LEN([o_orderstatus]) AS n, ISNULL(NULLIF([o_orderstatus], 'P'), 'open') AS s, CASE WHEN GETDATE() > '2000-01-01' THEN 1 ELSE 0 END AS later FROM [orders]"
    return spark.sql(shim.to_spark(sql, "sqlserver"))


# --- statements ----------------------------------------------------------------------------------

#: Statements for the rules that the workload of ``wl_advice`` doesn't meet.
MORE = (
    (1, "oracle", "SELECT b.isbn FROM books b WHERE EXISTS (SELECT 1 FROM loans l WHERE l.isbn = b.isbn) ORDER BY b.isbn"),
    (2, "mysql", "SELECT b.isbn FROM books b JOIN loans l ON l.isbn = b.isbn JOIN members m ON m.id = l.who WHERE m.id IS NOT NULL"),
    (3, "sqlite", "SELECT b.isbn FROM books b JOIN loans l ON l.isbn = b.isbn JOIN members m ON m.id = l.who WHERE m.id IS NOT NULL"),
    (4, "sqlite", "SELECT b.isbn FROM books b JOIN loans l ON l.isbn = b.isbn WHERE b.isbn IS NOT NULL"),
)


def advice_more(spark: SparkSession, d: str) -> DataFrame:
    found = analysis.advice(analysis.analyze_frame(spark.createDataFrame(MORE, "query_id bigint, dialect string, sql string")))
    return found.where("rule IN ('INEFFICIENT_SUBQUERY', 'MYSQL_ENGINE_HINT', 'SQLITE_PRAGMA_OPTIMIZATION')").select("query_id", "rule", "severity")


#: Comments of the dialects, also where a string or another comment holds their marks.
COMMENTS = (
    (1, "mysql", "SELECT a # not FROM here\nFROM t -- the end"),
    (2, "postgresql", "SELECT /* one\n two */ a, '-- no comment' FROM /**/ t"),
    (3, "sqlserver", "/* ; */ SELECT [a--b] FROM t /* last */"),
    (4, "oracle", "-- SELECT x FROM y\nDELETE FROM t WHERE a = '/*'"),
)


def comments(spark: SparkSession, d: str) -> DataFrame:
    found = analysis.analyze_frame(spark.createDataFrame(COMMENTS, "query_id bigint, dialect string, sql string"))
    return found.select("query_id", "query_type", F.col("tables")[0]["name"].alias("first_table"), F.size("columns").cast("long").alias("n_columns"), F.col("error").isNotNull().alias("failed"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and errors by dialect; times differ from run to run, so only that there are any is returned."""
    found = analysis.parse_metrics(analysis.workload(spark))
    return found.groupBy("dialect").agg(F.sum("tokens").alias("tokens"), F.count("error").alias("errors"), F.bool_and(F.col("micros") >= 0).alias("timed"))


# --- plans ---------------------------------------------------------------------------------------

_SHOWPLAN = """<ShowPlanXML><RelOp NodeId="0" PhysicalOp="Nested Loops" EstimateRows="40" EstimatedTotalSubtreeCost="3.5">
<OuterReferences/><RelOp NodeId="1" PhysicalOp="Table Scan" EstimateRows="900" EstimatedTotalSubtreeCost="2.5"><Object Table="[books]"/></RelOp>
<RelOp NodeId="2" PhysicalOp="Index Seek" EstimateRows="1" EstimatedTotalSubtreeCost="0.5"><Object Table="[loans]" Index="[by_isbn]"/></RelOp>
</RelOp></ShowPlanXML>"""
_QUERY_PLAN = "|--SCAN books\n`--SEARCH loans USING INDEX by_isbn (isbn=?)"


def plan_nodes(spark: SparkSession, d: str) -> DataFrame:
    plans = spark.createDataFrame([("a", "sqlserver", _SHOWPLAN), ("b", "sqlite", _QUERY_PLAN), ("c", "db9", "x")], "plan_id string, dialect string, plan string")
    return explain.plan_nodes(plans).select("plan_id", F.col("node_id").cast("long").alias("node_id"), "node_type", "table", "index", F.col("warning").isNotNull().alias("warned"))


# --- statistics and alerts -----------------------------------------------------------------------

def _queries(events: DataFrame) -> DataFrame:
    """Events as processed queries: a statement by type, and a duration."""
    kinds = {"purchase": "INSERT INTO sales VALUES (1)", "view": "SELECT * FROM items", "click": "UPDATE seen SET n = n + 1"}
    text = F.lit("DELETE FROM carts")
    for kind, sql in kinds.items():
        text = F.when(F.col("event_type") == kind, sql).otherwise(text)
    return events.select(text.alias("query"), (F.floor("value") / 32).alias("duration_s"))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    return monitor.statistics(_queries(table(spark, d, "events")), 1.5)


def stream_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: monitor.statistics(_queries(e), 1.5), "complete")


def alert_optimization(spark: SparkSession, d: str) -> DataFrame:
    """Statements with advice of at least a severity, through the rules' manager."""
    q = analysis.analyze_frame(analysis.workload(spark))
    severities = analysis.advice(q).groupBy("query_id").agg(F.collect_list("severity").alias("severities"))
    rows = q.join(severities, "query_id", "left").withColumn("timestamp", F.lit("2031-01-01").cast("timestamp")).withColumn("duration_s", F.lit(0.0)).drop("sql")
    manager = alerts.AlertManager([alerts.optimization(F.coalesce("severities", F.array().cast("array<string>")), "high")])
    return manager.alerts(rows.withColumn("query", F.col("query_id").cast("string"))).select("query", "level", "type")


QUERIES = {
    "source_detect_format": detect_format,
    "source_log_file": log_file,
    "source_last_lines": last_lines,
    "source_live_lines": live_lines,
    "source_tail": tail_stream,
    "source_schema_files": schema_documents,
    "source_config": configuration,
    "sink_json": _sink("json"),
    "sink_csv": _sink("csv"),
    "sink_parquet": _sink("parquet"),
    "sink_csv_nested": sink_csv_nested,
    "log_by_database": log_by_database,
    "ddl_tables": ddl_tables,
    "ddl_catalog": ddl_catalog,
    "constraint_not_null": null_violations,
    "dialect_reserved": reserved,
    "dialect_registry": registry,
    "dialect_functions": shim_functions,
    "wl_advice_more": advice_more,
    "wl_comments": comments,
    "wl_parse_metrics": metrics,
    "plan_nodes": plan_nodes,
    "monitor_statistics": statistics,
    "stream_statistics": stream_statistics,
    "alert_optimization": alert_optimization,
}

_ORDERS = "SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"
_STATISTICS = """
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE floor(value) / 32 >= 1.5) AS slow,
        COUNT(*) FILTER (WHERE event_type = 'view') AS selects, COUNT(*) FILTER (WHERE event_type = 'purchase') AS inserts,
        COUNT(*) FILTER (WHERE event_type = 'click') AS updates,
        COUNT(*) FILTER (WHERE event_type NOT IN ('view', 'purchase', 'click')) AS deletes, SUM(floor(value) / 32) AS seconds
    FROM events"""
#: Where no table is read, worked out by hand from the rules for the inline inputs above.
ORACLES = {
    "source_detect_format": """SELECT CAST(seq AS BIGINT) AS seq, format FROM (VALUES (0, 'Profiler'), (1, 'Profiler'), (2, 'Profiler'),
        (3, 'Profiler'), (4, 'Unknown'), (5, 'Unknown'), (6, 'ErrorLog'), (7, 'ExtendedEvents'), (8, 'QueryStore'),
        (9, 'PerformanceCounter'), (10, 'ErrorLog')) t(seq, format)""",
    "source_log_file": """SELECT format, query, CAST(ms AS BIGINT) AS duration_ms FROM (VALUES
        ('Profiler', 'SELECT title, shelf FROM books WHERE isbn = 9', 12), ('Profiler', 'DELETE FROM loans WHERE due < ''2030-01-01''', 8020),
        ('Profiler', 'SELECT COUNT(*) FROM members', 333), ('Profiler', 'INSERT INTO shelves (floor) VALUES (4)', 1),
        ('ErrorLog', 'DELETE FROM sessions', 0), ('ExtendedEvents', 'SELECT 1 WHERE 1 < 2', 42), ('QueryStore', 'EXEC refresh', 12)) t(format, query, ms)""",
    "source_last_lines": "SELECT 'line ' || k AS value FROM (VALUES (4999), (4998), (4997), (4996), (4994), (4993), (4992)) t(k)",
    "source_live_lines": """SELECT CAST(seq AS BIGINT) AS seq, query, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES (1, 'SELECT title FROM books', NULL),
        (2, 'DELETE FROM loans WHERE id = 4', 1.2505), (3, 'dbo.refresh_shelves 3', NULL), (4, 'update members set city = ''Rome'' where id = 9', NULL),
        (5, NULL, 2.75), (6, NULL, NULL), (7, NULL, NULL)) t(seq, query, seconds)""",
    "source_tail": "SELECT 't' || (k % 7) AS target, COUNT(*) AS n, COUNT(*) AS places FROM range(1500, 2000) t(k) GROUP BY k % 7",
    "source_schema_files": """SELECT * FROM (VALUES ('books', 'isbn', 'BIGINT', NULL, NULL, NULL, FALSE, TRUE, NULL),
        ('books', 'title', 'VARCHAR', 80, NULL, NULL, TRUE, FALSE, NULL), ('loans', 'id', 'INT', NULL, NULL, NULL, FALSE, TRUE, NULL),
        ('loans', 'isbn', 'BIGINT', NULL, NULL, NULL, FALSE, FALSE, NULL), ('loans', 'fee', 'DECIMAL', NULL, 8, 2, TRUE, FALSE, '0'))
        t("table", "column", type, length, precision, scale, nullable, is_pk, "default")""",
    "source_config": """SELECT * FROM (VALUES ('parser.dialect', 'mysql'), ('parser.max_query_size', '1000000'), ('logger.filters.min_duration_ms', '250'),
        ('output.format', 'json'), ('analyzer.complexity_threshold', 'refused')) t(name, value)""",
    "sink_json": _ORDERS,
    "sink_csv": _ORDERS,
    "sink_parquet": _ORDERS,
    "sink_csv_nested": "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, '[' || string_agg(l_linenumber, ',' ORDER BY l_linenumber) || ']' AS lines FROM lineitem GROUP BY l_orderkey",
    "log_by_database": "SELECT 'Sales' AS database, 1 AS n",
    "ddl_tables": "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'late' END AS note, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ddl_catalog": "SELECT * FROM (VALUES ('column', 'isbn', 'BIGINT'), ('column', 'pages', 'INT'), ('index', 'by_isbn', 'isbn,pages unique')) t(kind, name, type)",
    "constraint_not_null": """SELECT * FROM (SELECT 'who' AS "column", COUNT(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey IS NULL
        UNION ALL SELECT 'status', COUNT(*) FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus IS NULL) t WHERE n > 0""",
    "dialect_reserved": """SELECT * FROM (VALUES ('postgresql', 'ILIKE'), ('mysql', 'SELECT'), ('postgresql', 'SELECT'), ('sqlserver', 'SELECT'),
        ('sqlite', 'SELECT'), ('oracle', 'SELECT'), ('mysql', 'ZEROFILL'), ('sqlserver', 'VIEW'), ('sqlite', 'VIEW'), ('oracle', 'VIEW'),
        ('sqlserver', 'TOP'), ('oracle', 'ROWNUM'), ('sqlite', 'PRAGMA')) t(dialect, word)""",
    "dialect_registry": """SELECT * FROM (VALUES ('MySQL', 'MySQL', 'Standard'), ('postgres', 'PostgreSQL', 'Standard'), ('mssql', 'SQL Server', 'SQLServer'),
        ('sqlite', 'SQLite', 'Standard'), ('ORACLE', 'Oracle', 'Oracle'), ('unheard of', 'SQL Server', 'SQLServer'), ('', 'SQL Server', 'SQLServer'))
        t(asked, name, limit_syntax)""",
    "dialect_functions": "SELECT o_orderkey AS k, length(o_orderstatus) AS n, coalesce(nullif(o_orderstatus, 'P'), 'open') AS s, 1 AS later FROM orders",
    "wl_advice_more": """SELECT CAST(q AS BIGINT) AS query_id, rule, 'INFO' AS severity FROM (VALUES (1, 'INEFFICIENT_SUBQUERY'), (2, 'MYSQL_ENGINE_HINT'),
        (3, 'SQLITE_PRAGMA_OPTIMIZATION')) t(q, rule)""",
    "wl_comments": """SELECT CAST(q AS BIGINT) AS query_id, kind AS query_type, 't' AS first_table, CAST(n AS BIGINT) AS n_columns, FALSE AS failed
        FROM (VALUES (1, 'SELECT', 1), (2, 'SELECT', 1), (3, 'SELECT', 1), (4, 'DELETE', 1)) t(q, kind, n)""",
    "wl_parse_metrics": """SELECT dialect, CAST(tokens AS BIGINT) AS tokens, CAST(errors AS BIGINT) AS errors, TRUE AS timed FROM (VALUES ('mysql', 7 + 16 + 29 + 20, 0),
        ('postgresql', 18 + 22 + 11 + 20 + 34, 0), ('sqlserver', 17 + 20 + 3 + 9, 1), ('oracle', 74, 0), ('sqlite', 10, 0)) t(dialect, tokens, errors)""",
    "plan_nodes": """SELECT plan_id, CAST(node_id AS BIGINT) AS node_id, node_type, "table", "index", warned FROM (VALUES
        ('a', 0, 'NESTED_LOOP', NULL, NULL, FALSE), ('a', 1, 'TABLE_SCAN', 'books', NULL, FALSE), ('a', 2, 'INDEX_SCAN', 'loans', 'by_isbn', FALSE),
        ('b', 0, 'FULL_TABLE_SCAN', 'books', NULL, FALSE), ('b', 1, 'INDEX_SCAN', 'loans', 'by_isbn', FALSE), ('c', 0, NULL, NULL, NULL, TRUE))
        t(plan_id, node_id, node_type, "table", "index", warned)""",
    "monitor_statistics": _STATISTICS,
    "stream_statistics": _STATISTICS,
    "alert_optimization": "SELECT * FROM (VALUES ('2', 'INFO', 'OPTIMIZATION'), ('6', 'INFO', 'OPTIMIZATION'), ('14', 'INFO', 'OPTIMIZATION')) t(query, level, type)",
}
