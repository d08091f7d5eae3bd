"""Query logs: lines to entries by column expressions only, batch or streaming.

A line is tried as a profiler line, an Extended Events element, a Query Store object and an error-log line, in that
order; lines that are none are dropped. Fields that a format lacks are null or 0 as in the entry's schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d"
_COUNTERS = r"Duration:\s*(\d+)\s*ms.*CPU:\s*(\d+)\s*ms.*Reads:\s*(\d+).*Writes:\s*(\d+)"
KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "EXEC")
ENTRY = ("format", "timestamp", "duration_ms", "database", "user", "query", "logical_reads", "writes", "cpu_ms", "spid")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _entry(kind: str, when: Column, **values: Column) -> Column:
    types = {"timestamp": "timestamp", "duration_ms": "bigint", "logical_reads": "bigint", "writes": "bigint", "cpu_ms": "bigint", "spid": "int"}
    fields = [F.lit(kind).alias("format")] + [values.get(n, F.lit(0) if types.get(n) == "bigint" else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in ENTRY[1:]]
    return F.when(when, F.struct(*fields))


def _int(c: Column) -> Column:
    return F.coalesce(_some(c).cast("bigint"), F.lit(0))


def profiler(line: Column) -> Column:
    at, rest = F.regexp_extract(line, rf"^{_TIME}{{3}})\s+(.+)", 1), F.regexp_extract(line, rf"^{_TIME}{{3}})\s+(.+)", 2)
    query = F.coalesce(*(_some(F.regexp_extract(rest, rf"(?s)({k}.*)$", 1)) for k in ("SELECT", "INSERT", "UPDATE", "DELETE")))
    user = _some(F.regexp_extract(rest, r"LoginName[=:]\s*(\S+)", 1))
    return _entry("Profiler", at != "", timestamp=F.try_to_timestamp(at), query=F.trim(F.regexp_replace(query, r"\s*Duration:\s*\d+\s*ms.*$", "")), user=user, spid=_some(F.regexp_extract(rest, r"(?i)spid[=:]?\s*(\d+)", 1)), **{k: _int(F.regexp_extract(rest, _COUNTERS, n)) for n, k in enumerate(("duration_ms", "cpu_ms", "logical_reads", "writes"), 1)})


def extended_events(line: Column) -> Column:
    attr = lambda n: F.regexp_extract(line, rf'\b{n}="([^"]*)"', 1)
    text = attr("statement")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return _entry("ExtendedEvents", line.contains("sql_statement_completed") & line.contains("<event"), timestamp=F.try_to_timestamp(_some(attr("timestamp"))), duration_ms=F.floor(_int(attr("duration")) / 1000), query=_some(text), database=_some(attr("database_name")), user=_some(attr("username")), logical_reads=_int(attr("logical_reads")), writes=_int(attr("writes")), cpu_ms=F.floor(_int(attr("cpu_time")) / 1000))


def query_store(line: Column) -> Column:
    doc = F.from_json(F.when(line.startswith("{"), line), "query_sql_text string, avg_duration double, avg_logical_io_reads double, avg_logical_io_writes double, avg_cpu_time double")
    return _entry("QueryStore", doc["query_sql_text"].isNotNull(), query=doc["query_sql_text"], duration_ms=F.coalesce(doc["avg_duration"], F.lit(0)), logical_reads=F.coalesce(doc["avg_logical_io_reads"], F.lit(0)), writes=F.coalesce(doc["avg_logical_io_writes"], F.lit(0)), cpu_ms=F.coalesce(doc["avg_cpu_time"], F.lit(0)))


def error_log(line: Column) -> Column:
    part = lambda n: F.regexp_extract(line, rf"^{_TIME}{{2}})\s+(\w+)\s+(.+)", n)
    return _entry("ErrorLog", (part(1) != "") & part(3).rlike(f"(?i){'|'.join(KEYWORDS)}"), timestamp=F.try_to_timestamp(part(1)), query=part(3), spid=F.regexp_extract(part(2), r"spid(\d+)", 1).try_cast("int"))


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Entries of a frame of lines: one projection, no shuffle."""
    line = F.trim(F.col(col))
    return lines.select(F.coalesce(profiler(line), extended_events(line), query_store(line), error_log(line)).alias("e")).where("e IS NOT NULL").select("e.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def detect_format(line: Column) -> Column:
    """The log format that a sample looks like; the first that fits."""
    has = lambda *words: F.greatest(*(line.contains(w) for w in words))
    return F.when(has("<event name=", "xml version=", "<Events>"), "ExtendedEvents").when(has("query_sql_text", "avg_duration", "execution_count"), "QueryStore").when(has("SQL:BatchCompleted", "RPC:Completed", "LoginEvent"), "Profiler").when(has("spid", "Login succeeded", "Error:", "Warning:"), "ErrorLog").when(has("Duration:", "CPU:", "Reads:", "Writes:"), "PerformanceCounter").otherwise("Unknown")


def query_type(query: Column) -> Column:
    """The kind of statement by its first word."""
    q = F.upper(F.trim(query))
    out = F.lit("OTHER")
    for w in reversed(("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")):
        out = F.when(q.startswith(w), w).otherwise(out)
    return F.when(F.coalesce(query, F.lit("")) == "", "UNKNOWN").when(q.startswith("EXEC"), "EXECUTE").otherwise(out)


def filter_entries(entries: DataFrame, min_duration: int = 0, max_duration: int = 0, database: str = "", user: str = "", query_type_prefix: str = "", min_reads: int = 0, max_reads: int = 0, exclude_system: bool = False) -> DataFrame:
    """0 and empty turn a filter off; database and user in any case."""
    out = entries
    if min_duration:
        out = out.where(F.col("duration_ms") >= min_duration)
    if max_duration:
        out = out.where(F.col("duration_ms") <= max_duration)
    if database:
        out = out.where(F.lower("database") == database.lower())
    if user:
        out = out.where(F.lower("user") == user.lower())
    if query_type_prefix:
        out = out.where(F.upper(F.trim("query")).startswith(query_type_prefix.upper()))
    if min_reads:
        out = out.where(F.col("logical_reads") >= min_reads)
    if max_reads:
        out = out.where(F.col("logical_reads") <= max_reads)
    if exclude_system:
        out = out.where(~F.coalesce(F.lower("database").isin("master", "msdb", "model", "tempdb"), F.lit(False)))
    return out


def metrics(entries: DataFrame) -> DataFrame:
    """Totals; zeros for no entries."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return entries.agg(F.count("*").alias("total"), z(F.avg("duration_ms")).cast("double").alias("avg_ms"), z(F.min("duration_ms")).alias("min_ms"), z(F.max("duration_ms")).alias("max_ms"), z(F.sum("logical_reads")).alias("reads"), z(F.sum("writes")).alias("writes"))


def by_type(entries: DataFrame) -> DataFrame:
    return entries.groupBy(query_type(F.col("query")).alias("query_type")).agg(F.count("*").alias("n"))


def by_database(entries: DataFrame) -> DataFrame:
    return entries.where("database IS NOT NULL").groupBy("database").agg(F.count("*").alias("n"))


def by_hour(entries: DataFrame) -> DataFrame:
    return entries.where("timestamp IS NOT NULL").groupBy(F.hour("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def extract_query(line: Column) -> Column:
    """The statement of a live log line of MySQL, PostgreSQL or SQL Server, or a bare one; null if there is none."""
    t = F.trim(line)
    patterns = (r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+(?:\d+\s+)?Query\s+(.+)$", r"(?i)LOG:\s+(?:duration: \S+ ms\s+)?statement:\s+(.+)$", r"(?i)^.*?\bexec(?:ute)?\s+(.+)$", r"(?is)^((?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|MERGE|WITH)\b.+)$")
    return F.coalesce(*(_some(F.trim(F.regexp_extract(t, p, 1))) for p in patterns))


def extract_duration(line: Column) -> Column:
    """Seconds that a live line states, else null."""
    ms = F.coalesce(_some(F.regexp_extract(line, r"(?i)duration:\s*([0-9.]+)\s*ms", 1)), F.lit(None)).try_cast("double") / 1000
    return F.coalesce(ms, _some(F.regexp_extract(line, r"(?i)Query_time:\s*([0-9.]+)", 1)).try_cast("double"))


def last_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n non-empty lines of one file in order. A file's partitions are in its order, so their line numbers
    grow with it: a top-k, no sort of the whole."""
    numbered = spark.read.text(path).where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return numbered.orderBy(F.desc("seq")).limit(n).orderBy("seq").select("value")
