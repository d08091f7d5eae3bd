"""Statements as data: what a query reads and how, its complexity, and advice about it.

Parsing is Python on executors, once for each distinct text (and dialect); everything after it, the advice rules
included, is column expressions over the facts that parsing leaves. A text that doesn't parse is a row with an error.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.sqlparse import Node, SqlError, parse, tokens

FACTS = "query_type string, n_from int, n_joins int, has_star boolean, has_where boolean, has_limit boolean, has_order boolean, is_distinct boolean, where_functions array<string>, where_in_subquery boolean, where_exists boolean, where_compares boolean, where_concat boolean, where_json boolean, longest_in int, where_chars int, bare_joins int, join_tables array<string>, nolock boolean"
ANALYSIS = (
    "query_type string, complexity int, tables array<struct<schema:string,name:string,alias:string,usage:string>>, columns array<struct<table:string,name:string,usage:string>>, "
    "joins array<struct<type:string,left_table:string,right_table:string,condition:string>>, conditions array<struct<table:string,column:string,operator:string,value:string>>, "
    f"facts struct<{FACTS.replace(' ', ':').replace(',:', ',')}>, error string"
)
_COMPARES = {"=", "==", "<>", "!=", "<", ">", "<=", ">="}
_SLOW_FUNCTIONS = ("UPPER", "LOWER", "TRIM", "SUBSTRING", "DATEPART", "YEAR", "MONTH", "DAY")


def render(n: Node) -> str:
    """An expression as text."""
    k, v = n.kind, n.kids
    if k == "column":
        return f"{n.table}.{n.value}" if n.table else n.value
    if k == "lit":
        return "NULL" if n.value is None else f"'{n.value}'" if n.get("type") in ("string", "date", "time", "timestamp") else str(n.value).upper() if isinstance(n.value, bool) else str(n.value)
    if k == "star":
        return f"{n.value}.*" if n.value else "*"
    if k == "binary":
        return f"({render(v[0])} {n.value} {render(v[1])})"
    if k == "unary":
        return f"({n.value} {render(v[0])})"
    if k == "func":
        return f"{n.value}({'DISTINCT ' if n.get('distinct') else ''}{', '.join(map(render, v))})"
    if k == "in":
        what = "..." if n.get("query") else ", ".join(map(render, v[1:]))
        return f"({render(v[0])} {'NOT ' * n.value}IN ({what}))"
    if k == "between":
        return f"({render(v[0])} {'NOT ' * n.value}BETWEEN {render(v[1])} AND {render(v[2])})"
    if k == "like":
        return f"({render(v[0])} {'NOT ' * n.negated}{n.value} {render(v[1])})"
    if k == "is":
        return f"({render(v[0])} IS {'NOT ' * n.negated}{n.value})"
    if k == "cast":
        return f"CAST({render(v[0])} AS {n.value})"
    return {"exists": "EXISTS (...)", "subquery": "(...)", "case": "CASE ... END", "param": str(n.value)}.get(k, k.upper())


_SCOPES = ("select", "setop", "with", "values")


def _within(n: Node) -> Iterator[Node]:
    """Nodes of an expression, not into its subqueries."""
    stack = [n]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(list(x.children())) if c.kind not in _SCOPES]


def _conjuncts(n: Node) -> Iterator[Node]:
    if n.kind == "binary" and n.value in ("AND", "OR"):
        for k in n.kids:
            yield from _conjuncts(k)
    elif n.kind == "unary" and n.value == "NOT":
        yield from _conjuncts(n.kids[0])
    else:
        yield n


class _Collector:
    """Tables, columns, joins and conditions of a statement, subqueries included, in the order of the text."""

    def __init__(self) -> None:
        self.tables: list[tuple[str, str, str, str]] = []
        self.columns: list[tuple[str, str, str]] = []
        self.joins: list[tuple[str, str, str, str]] = []
        self.conditions: list[tuple[str, str, str, str]] = []
        self.ctes: set[str] = set()

    def expr(self, n: Node | None, usage: str) -> None:
        if n is None:
            return
        for x in _within(n):
            if x.kind == "column":
                self.columns.append((x.table, x.value, usage))
            for c in x.children():
                if c.kind in _SCOPES:
                    self.query(c)

    def where(self, n: Node | None, usage: str = "WHERE") -> None:
        if n is None:
            return
        self.expr(n, usage)
        for c in _conjuncts(n):
            if c.kind == "binary" and c.value in _COMPARES and len(c.kids) == 2:
                a, b = c.kids
                if a.kind == "column" and b.kind in ("lit", "param"):
                    self.conditions.append((a.table, a.value, c.value, str(b.value)))
                elif b.kind == "column" and a.kind in ("lit", "param"):
                    flipped = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(c.value, c.value)
                    self.conditions.append((b.table, b.value, flipped, str(a.value)))
            elif c.kind == "between" and c.kids[0].kind == "column":
                self.conditions.append((c.kids[0].table, c.kids[0].value, "NOT BETWEEN" if c.value else "BETWEEN", f"{render(c.kids[1])} AND {render(c.kids[2])}"))
            elif c.kind == "like" and c.kids[0].kind == "column" and c.kids[1].kind == "lit":
                self.conditions.append((c.kids[0].table, c.kids[0].value, ("NOT " if c.negated else "") + c.value, str(c.kids[1].value)))
            elif c.kind == "in" and c.kids[0].kind == "column" and not c.get("query"):
                self.conditions.append((c.kids[0].table, c.kids[0].value, "NOT IN" if c.value else "IN", ", ".join(map(render, c.kids[1:]))))
            elif c.kind == "is" and c.kids[0].kind == "column":
                self.conditions.append((c.kids[0].table, c.kids[0].value, "IS NOT" if c.negated else "IS", c.value))

    def source(self, n: Node, usage: str = "SELECT") -> str:
        """Adds a table reference; its name for joins."""
        if n.kind == "table":
            if n.value.lower() not in self.ctes or n.get("schema"):
                self.tables.append((n.get("schema", ""), n.value, n.get("alias", ""), usage))
            return n.get("alias") or n.value
        if n.kind == "derived":
            self.query(n.kids[0])
        elif n.kind == "nested":
            left = self.source(n.kids[0])
            for j in n.kids[1:]:
                left = self.join(j, left)
        else:
            for k in n.kids:
                self.expr(k, "SELECT")
        return str(n.value or "")

    def join(self, j: Node, left: str) -> str:
        right = self.source(j.kids[0])
        on = j.get("on")
        text = render(on) if on is not None else f"USING ({', '.join(j.using)})" if j.get("using") else ""
        if on is not None:
            # The nearest other table that the condition names, else the one to the left.
            named = [x.table for x in _within(on) if x.kind == "column" and x.table and x.table.lower() != right.lower()]
            left = named[0] if named else left
            self.expr(on, "JOIN")
        self.joins.append((j.value, left, right, text))
        return right

    def sources(self, refs: list[Node], joins: list[Node]) -> None:
        last = ""
        for r in refs:
            last = self.source(r)
        for j in joins:
            last = self.join(j, last)

    def query(self, q: Node) -> None:
        if q.kind == "with":
            for c in q.kids[:-1]:
                if q.value:
                    self.ctes.add(c.value.lower())
                self.statement(c.kids[0])
                self.ctes.add(c.value.lower())
            self.statement(q.main)
        elif q.kind == "setop":
            for k in q.kids:
                self.query(k)
            for o in q.get("order", []):
                self.expr(o, "ORDER_BY")
        elif q.kind == "values":
            for r in q.kids:
                self.expr(r, "SELECT")
        elif q.kind == "select":
            self.sources(q.get("from", []), q.get("joins", []))
            for i in q.items:
                self.expr(i, "SELECT")
            self.where(q.get("where"))
            for g in q.get("group", []):
                self.expr(g, "GROUP_BY")
            self.expr(q.get("having"), "HAVING")
            self.expr(q.get("qualify"), "HAVING")
            for w in q.get("windows", []):
                self.expr(w, "SELECT")
            for o in q.get("order", []):
                self.expr(o, "ORDER_BY")

    def statement(self, n: Node) -> None:
        k = n.kind
        if k in _SCOPES:
            self.query(n)
        elif k == "insert":
            self.tables.append((n.schema, n.value, "", "INSERT"))
            self.columns += [(n.value, c, "INSERT") for c in n.columns]
            for r in n.get("rows", []):
                self.expr(r, "INSERT")
            if n.get("query") is not None:
                self.query(n.query)
            for a in n.get("assignments", []):
                self.columns.append((a.table, a.value, "UPDATE"))
                self.expr(a.kids[0], "UPDATE")
        elif k in ("update", "delete"):
            usage = k.upper()
            self.source(n.kids[0], usage)
            self.sources(n.get("from", []), n.get("joins", []))
            for a in n.get("assignments", []):
                self.columns.append((a.table or n.value, a.value, usage))
                self.expr(a.kids[0], usage)
            self.where(n.get("where"))
            for o in n.get("order", []):
                self.expr(o, "ORDER_BY")
        elif k == "merge":
            self.source(n.kids[0], "MERGE")
            self.source(n.kids[1])
            self.expr(n.on, "JOIN")
            for c in n.clauses:
                self.expr(c.get("condition"), "WHERE")
                for a in c.get("assignments", []):
                    self.columns.append((a.table or n.value, a.value, "UPDATE"))
                    self.expr(a.kids[0], "UPDATE")
                self.columns += [(n.value, x, "INSERT") for x in c.get("columns", [])]
                for v in c.get("values", []):
                    self.expr(v, "INSERT")
        elif k == "create table":
            self.tables.append((n.schema, n.value, "", "CREATE"))
            self.columns += [(n.value, c.value, "CREATE") for c in n.get("columns", [])]
            if n.get("query") is not None:
                self.query(n.query)
        elif k == "create view":
            self.tables.append((n.schema, n.value, "", "CREATE"))
            self.query(n.query)
        elif k == "create index":
            self.tables.append(("", n.table, "", "INDEX"))
            self.columns += [(n.table, c.value, "INDEX") for c in n.columns if c.kind == "column"]
        elif k == "create trigger":
            self.tables.append(("", n.table, "", "CREATE"))
        elif k == "drop":
            if n.object in ("TABLE", "VIEW", "MATERIALIZED VIEW"):
                self.tables.append((n.schema, n.value, "", "DROP"))
        elif k == "alter table":
            self.tables.append((n.schema, n.value, "", "ALTER"))
            column = n.get("column_name") or (n.column.value if n.get("column") else "")
            if column:
                self.columns.append((n.value, column, f"ALTER {n.action}"))
        elif k == "explain":
            self.statement(n.kids[0])
        else:
            for c in n.children():
                if c.kind in ("binary", "column", "func", "unary", "in", "case", "subquery", "exists", "between", "like", "is"):
                    self.expr(c, "SCRIPT")
                else:
                    self.statement(c)


def query_type(n: Node) -> str:
    """The kind of statement; a WITH is named by its main statement's kind."""
    if n.kind == "with":
        return query_type(n.main)
    if n.kind == "drop":
        return f"DROP {n.object}"
    if n.kind == "explain":
        return "EXPLAIN"
    if n.kind == "transaction":
        return n.value
    return {"select": "SELECT", "setop": "SELECT", "values": "SELECT", "call": "EXECUTE", "block": "SCRIPT"}.get(n.kind, n.kind.upper())


def facts(n: Node) -> dict:
    """What the advice rules ask of the top select, and of nothing else."""
    top = n if n.kind == "select" else None
    where = top.get("where") if top else n.get("where") if n.kind in ("update", "delete") else None
    inner = list(_within(where)) if where is not None else []
    text = render(where) if where is not None else ""
    funcs = [x.value for x in inner if x.kind == "func"]
    joins = top.get("joins", []) if top else []
    strings = lambda x: x.kind == "lit" and x.get("type") == "string"
    glued = any(x.value in ("CONCAT", "CONCAT_WS") for x in inner if x.kind == "func") or any(x.kind == "binary" and (x.value == "||" or (x.value == "+" and any(map(strings, x.kids)))) for x in inner)
    hints = any("NOLOCK" in x.get("hints", []) for x in n.walk() if x.kind == "table")
    return {
        "query_type": query_type(n) if n.kind != "with" else f"WITH {query_type(n)}",
        "n_from": len(top.get("from", [])) if top else 0, "n_joins": len(joins), "has_star": bool(top) and any(i.kids[0].kind == "star" for i in top.items), "has_where": where is not None,
        "has_limit": bool(top) and top.get("limit") is not None, "has_order": bool(top) and bool(top.get("order")), "is_distinct": bool(top) and top.distinct,
        "where_functions": [f for f in _SLOW_FUNCTIONS if f in funcs], "where_in_subquery": any(x.kind == "in" and x.get("query") is not None for x in inner), "where_exists": any(x.kind == "exists" for x in inner),
        "where_compares": any(x.kind == "binary" and x.value in _COMPARES for x in inner), "where_concat": glued, "where_json": "JSON" in text.upper() and "JSONB" not in text.upper() or any(x.kind == "binary" and x.value in ("->", "->>") for x in inner),
        "longest_in": max([len(x.kids) - 1 for x in inner if x.kind == "in" and x.get("query") is None], default=0), "where_chars": len(text), "bare_joins": sum(j.get("on") is None and not j.get("using") and not j.get("natural") and "APPLY" not in j.value for j in joins),
        "join_tables": [str(j.kids[0].value or "") for j in joins], "nolock": hints,
    }


def analyze(sql: str, dialect: str | None = None) -> dict:
    """The analysis record of one statement."""
    out: dict = {"query_type": None, "complexity": None, "tables": [], "columns": [], "joins": [], "conditions": [], "facts": None, "error": None}
    try:
        return out | _analysis(sql, dialect)
    except SqlError as e:
        return out | {"error": str(e)}
    except RecursionError:
        return out | {"error": "nested too deeply"}


def _analysis(sql: str, dialect: str | None) -> dict:
    tree = parse(sql, dialect)
    c = _Collector()
    c.statement(tree)
    named = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
    return {
        "query_type": query_type(tree),
        "complexity": len(c.tables) + 2 * len(c.joins) + len(c.conditions) + sum(x[2] == "SELECT" for x in c.columns),
        "tables": named(("schema", "name", "alias", "usage"), c.tables),
        "columns": named(("table", "name", "usage"), c.columns),
        "joins": named(("type", "left_table", "right_table", "condition"), c.joins),
        "conditions": named(("table", "column", "operator", "value"), c.conditions),
        "facts": facts(tree),
    }


#: Python frames that a statement's tree may take; long chains of AND nest by one for each term.
MOST_FRAMES = 60_000


def _analyzed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), MOST_FRAMES))
    for b in batches:
        rows = [analyze(s, d) for s, d in zip(b["sql"], b["dialect"], strict=True)]
        yield pd.concat([b[["sql", "dialect"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)


def analyze_frame(workload: DataFrame, distinct: bool = True) -> DataFrame:
    """(query_id, sql, dialect, analysis columns) for (query_id, sql, dialect). With ``distinct`` each text is parsed
    once and its analysis joined back, which pays for logs that repeat themselves; hot texts are split by adaptive
    execution. The distinct texts are dealt to all cores: adaptive execution would put texts of a few megabytes into
    one task, but parsing them takes time by statement. A null text is an error row."""
    rows = workload.select("query_id", F.coalesce("sql", F.lit("")).alias("sql"), F.lower(F.coalesce("dialect", F.lit(""))).alias("dialect"))
    if not distinct:
        joined = rows.mapInPandas(lambda bs: (pd.concat([b[["query_id"]].reset_index(drop=True), next(_analyzed(iter([b])))], axis=1) for b in bs), f"query_id {rows.schema['query_id'].dataType.simpleString()}, sql string, dialect string, {ANALYSIS}")
        return joined
    spark = workload.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = rows.select("sql", "dialect").distinct().repartition(tasks, "sql", "dialect")
    parsed = texts.mapInPandas(_analyzed, f"sql string, dialect string, {ANALYSIS}")
    return rows.join(parsed, ["sql", "dialect"]).select("query_id", "sql", "dialect", *parsed.columns[2:])


def token_frame(workload: DataFrame) -> DataFrame:
    """(query_id, seq, type, literal, pos, line, col)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, k, t.type, t.text, t.pos, t.line, t.column) for q, s, d in zip(b["query_id"], b["sql"], b["dialect"], strict=True) for k, t in enumerate(tokens(s or "", d)[:-1])]
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "seq", "type", "literal", "pos", "line", "col"])

    kind = workload.schema["query_id"].dataType.simpleString()
    return workload.select("query_id", "sql", "dialect").mapInPandas(run, f"query_id {kind}, seq int, type string, literal string, pos int, line int, col int")


def parse_metrics(workload: DataFrame) -> DataFrame:
    """(query_id, dialect, tokens, micros, error): what parsing each statement took. A text that can't be cut into tokens
    has none, and an error. Totals come by aggregation, or by ``observe`` on the way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), MOST_FRAMES))
        for b in batches:
            rows = []
            for s, d in zip(b["sql"], b["dialect"], strict=True):
                begun, n, error = time.perf_counter_ns(), 0, None
                try:
                    n = len(tokens(s or "", d)) - 1
                    parse(s or "", d)
                except (SqlError, RecursionError) as e:
                    error = str(e)
                rows.append((n, (time.perf_counter_ns() - begun) // 1000, error))
            out = pd.DataFrame(rows, columns=["tokens", "micros", "error"])
            out.insert(0, "query_id", b["query_id"].to_numpy())
            out.insert(1, "dialect", b["dialect"].to_numpy())
            yield out

    kind = workload.schema["query_id"].dataType.simpleString()
    fields = f"query_id {kind}, dialect string, tokens long, micros long, error string"
    return workload.select("query_id", "sql", "dialect").mapInPandas(run, fields)


# --- advice --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``when`` is SQL over ``facts`` (as f); ``each`` an array expression that repeats the advice for its items."""

    name: str
    type: str
    when: str
    severity: str
    category: str
    impact: str
    description: str
    suggestion: str
    dialect: str = ""
    auto_fixable: bool = False
    each: str = ""
    statements: str = "SELECT"


# Names, types, severities, categories and impacts.
RULES = (
    Rule("SELECT_STAR", "SELECT_STAR", "f.has_star", "WARNING", "PERFORMANCE", "MEDIUM", "Every column is read", "Name the columns that are needed"),
    Rule("MISSING_WHERE", "MISSING_WHERE", "NOT f.has_where", "INFO", "PERFORMANCE", "HIGH", "Every row is read", "Add a WHERE clause"),
    Rule("CARTESIAN_PRODUCT", "CARTESIAN_PRODUCT", "(f.n_from > 1 AND f.n_joins = 0) OR f.bare_joins > 0", "CRITICAL", "PERFORMANCE", "HIGH", "Tables meet without a join condition", "Join with explicit conditions"),
    Rule("FUNCTION_IN_WHERE", "FUNCTION_IN_WHERE", "size(f.where_functions) > 0", "WARNING", "PERFORMANCE", "MEDIUM", "A function on a column keeps an index from being used", "Compare the bare column", each="f.where_functions"),
    Rule("INEFFICIENT_SUBQUERY", "INEFFICIENT_SUBQUERY", "f.where_in_subquery OR f.where_exists", "INFO", "PERFORMANCE", "MEDIUM", "A subquery filters rows", "Consider a join"),
    Rule("UNNECESSARY_DISTINCT", "UNNECESSARY_DISTINCT", "f.is_distinct AND f.n_joins = 0", "INFO", "PERFORMANCE", "LOW", "DISTINCT over a query without joins", "Drop DISTINCT if rows are distinct already", auto_fixable=True),
    Rule("MISSING_INDEX_HINT", "INDEX_SUGGESTION", "f.where_compares", "INFO", "PERFORMANCE", "HIGH", "Compared columns could be indexed", "Index columns of the WHERE clause"),
    Rule("MISSING_INDEX_HINT", "INDEX_SUGGESTION", "f.n_joins > 0", "INFO", "PERFORMANCE", "HIGH", "Join columns could be indexed", "Index the join columns", each="f.join_tables"),
    Rule("INEFFICIENT_JOIN_ORDER", "JOIN_ORDER", "f.n_joins > 2", "INFO", "PERFORMANCE", "MEDIUM", "Many joins", "Join the most selective tables first"),
    Rule("SQL_INJECTION_RISK", "SQL_INJECTION_RISK", "f.where_concat", "CRITICAL", "SECURITY", "HIGH", "Text is glued together in the WHERE clause", "Use parameters"),
    Rule("OVERPRIVILEGED_SELECT", "OVERPRIVILEGED_SELECT", "f.has_star AND NOT f.has_where", "WARNING", "SECURITY", "MEDIUM", "Every column of every row is read", "Limit columns and rows"),
    Rule("MYSQL_LIMIT_OPTIMIZATION", "MYSQL_LIMIT_WITHOUT_ORDER", "f.has_limit AND NOT f.has_order", "WARNING", "PERFORMANCE", "MEDIUM", "LIMIT without an order gives any rows", "Add ORDER BY", "mysql"),
    Rule("MYSQL_ENGINE_HINT", "MYSQL_STORAGE_ENGINE", "f.n_joins > 1", "INFO", "PERFORMANCE", "LOW", "Several joins", "See that tables use a transactional engine", "mysql"),
    Rule("POSTGRESQL_JSON_OPTIMIZATION", "POSTGRESQL_JSON_TYPE", "f.where_json", "INFO", "PERFORMANCE", "MEDIUM", "JSON is searched as text", "Store it as JSONB", "postgresql"),
    Rule("POSTGRESQL_ARRAY_OPTIMIZATION", "POSTGRESQL_ARRAY_USAGE", "f.longest_in > 6", "INFO", "PERFORMANCE", "MEDIUM", "A long IN list", "Compare with ANY of an array", "postgresql"),
    Rule("SQLSERVER_TOP_OPTIMIZATION", "SQLSERVER_TOP_VS_LIMIT", "f.has_limit", "WARNING", "PERFORMANCE", "LOW", "LIMIT isn't known here", "Use TOP", "sqlserver", True),
    Rule("SQLSERVER_NOLOCK_WARNING", "SQLSERVER_NOLOCK_WARNING", "f.nolock", "WARNING", "SECURITY", "HIGH", "NOLOCK reads uncommitted rows", "Choose an isolation level", "sqlserver", statements=""),
    Rule("SQLITE_PRAGMA_OPTIMIZATION", "SQLITE_PRAGMA_SUGGESTION", "f.n_joins >= 2 OR f.where_chars > 100", "INFO", "PERFORMANCE", "MEDIUM", "A complex query", "Look at PRAGMA settings", "sqlite"),
    Rule("ORACLE_HINT_OPTIMIZATION", "ORACLE_HINT_SUGGESTION", "f.n_from + f.n_joins > 3", "INFO", "PERFORMANCE", "MEDIUM", "Many tables", "Consider optimizer hints", "oracle"),
)


def advice(analyzed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each piece of advice: one array of structs for each statement, exploded. No shuffle."""
    dialect = F.when(F.col("dialect").isin("postgres"), "postgresql").when(F.col("dialect").isin("mssql"), "sqlserver").when(F.col("dialect").isin("mysql", "postgresql", "sqlite", "oracle"), F.col("dialect")).otherwise("sqlserver")

    def found(k: int, r: Rule) -> Column:
        hit = F.expr(r.when)
        if r.statements:
            hit = hit & (F.col("f.query_type") == r.statements)
        if r.dialect:
            hit = hit & (F.col("_d") == r.dialect)
        item = lambda x: F.struct(F.lit(k).alias("seq"), F.lit(r.name).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.impact).alias("impact"), F.lit(r.description).alias("description"), F.lit(r.suggestion).alias("suggestion"), F.lit(r.dialect or None).cast("string").alias("rule_dialect"), F.lit(r.auto_fixable).alias("auto_fixable"), x.alias("subject"))
        many = F.transform(F.expr(r.each), item) if r.each else F.array(item(F.lit(None).cast("string")))
        return F.when(F.coalesce(hit, F.lit(False)), many)

    rows = analyzed.select("query_id", dialect.alias("_d"), F.col("facts").alias("f")).where("f IS NOT NULL")
    every = F.flatten(F.array_compact(F.array(*(found(k, r) for k, r in enumerate(rules)))))
    return rows.select("query_id", F.explode(every).alias("a")).select("query_id", "a.*")


def basic_suggestions(analyzed: DataFrame) -> DataFrame:
    """SELECT_ALL, CARTESIAN_PRODUCT (several tables, no join, no WHERE), COMPLEX_QUERY (over five tables)."""
    item = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))
    f = F.col("facts")
    rules = F.array_compact(F.array(F.when(f["has_star"], item("SELECT_ALL", "WARNING")), F.when((f["n_from"] > 1) & (f["n_joins"] == 0) & ~f["has_where"], item("CARTESIAN_PRODUCT", "ERROR")), F.when(F.size("tables") > 5, item("COMPLEX_QUERY", "INFO"))))
    return analyzed.where(f["query_type"] == "SELECT").select("query_id", F.explode(rules).alias("a")).select("query_id", "a.*")


# --- a fixed workload for the driver's queries ---------------------------------------------------

WORKLOAD = (
    (1, "mysql", "SELECT * FROM loans ORDER BY due"),
    (2, "postgresql", "SELECT b.title, m.city, b.shelf FROM books b, members m"),
    (3, "sqlserver", "SELECT isbn, title FROM books WHERE TRIM(title) <> '' AND pages > 300"),
    (4, "mysql", "SELECT title, COUNT(*) AS n FROM loans GROUP BY title LIMIT 25"),
    (5, "postgresql", "SELECT title FROM books WHERE isbn IN (SELECT l.isbn FROM loans l WHERE l.due IS NULL)"),
    (6, "mysql", "SELECT s.*, b.isbn FROM shelves s, books b WHERE LOWER(b.title) LIKE 'a%' OR s.floor = 2"),
    (7, "sqlserver", "SELECT DISTINCT [u].[name] FROM [users] [u] WITH (NOLOCK) WHERE [u].[age] BETWEEN 18 AND 65"),
    (8, "oracle", "SELECT u.name, SUM(o.total) AS spent FROM users u JOIN orders o ON u.id = o.user_id LEFT JOIN products p ON o.product_id = p.id JOIN stock s ON s.product_id = p.id WHERE o.status = 'done' GROUP BY u.name HAVING SUM(o.total) > 10 ORDER BY spent DESC"),
    (9, "sqlite", "UPDATE users SET name = 'x' WHERE id = 3"),
    (10, "postgresql", "DELETE FROM orders WHERE status = 'old' AND total < 5"),
    (11, "postgresql", "WITH t AS (SELECT id FROM users WHERE age > 30) SELECT COUNT(*) FROM t"),
    (12, "mysql", "INSERT INTO orders (user_id, total) VALUES (1, 9.5), (2, 7)"),
    (13, "sqlserver", "SELECT FROM WHERE"),
    (14, "postgresql", "SELECT id FROM users WHERE name = 'a' || 'b' OR data ->> 'k' = 'v' OR id IN (1, 2, 3, 4, 5, 6, 7)"),
    (15, "sqlserver", "SELECT name FROM users ORDER BY name LIMIT 5"),
)


def workload(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORKLOAD, "query_id bigint, dialect string, sql string")
