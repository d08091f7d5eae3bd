"""Execution plans as rows: nodes of EXPLAIN output from other engines and from Spark, issues and scores.

A plan is a JSON or text column; its nodes become rows (plan_id, node_id, parent_id, depth, ...). Statistics,
bottlenecks, issues and scores are filters and aggregates over those rows, so any number of plans is one job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "plan_id string, node_id int, parent_id int, depth int, node_type string, operation string, table string, index string, condition string, startup_cost double, total_cost double, est_rows long, act_rows long, children int, warning string"
# Node types by operator name.
_PG = {"Seq Scan": "SEQ_SCAN", "Index Scan": "INDEX_SCAN", "Index Only Scan": "INDEX_SCAN", "Bitmap Heap Scan": "BITMAP_SCAN", "Bitmap Index Scan": "BITMAP_SCAN", "Nested Loop": "NESTED_LOOP", "Hash Join": "HASH_JOIN", "Merge Join": "MERGE_JOIN", "Aggregate": "AGGREGATE", "Sort": "SORT"}
_MYSQL = {"ALL": "FULL_TABLE_SCAN", "index": "INDEX_SCAN", "range": "RANGE_SCAN"}
_SPARK = {"FileScan": "SEQ_SCAN", "Scan": "SEQ_SCAN", "BroadcastHashJoin": "HASH_JOIN", "ShuffledHashJoin": "HASH_JOIN", "SortMergeJoin": "MERGE_JOIN", "BroadcastNestedLoopJoin": "NESTED_LOOP", "CartesianProduct": "NESTED_LOOP", "HashAggregate": "HASH_AGGREGATE", "ObjectHashAggregate": "HASH_AGGREGATE", "SortAggregate": "AGGREGATE", "Sort": "SORT"}
FULL_SCANS = ("SEQ_SCAN", "TABLE_SCAN", "FULL_TABLE_SCAN")
INDEX_SCANS = ("INDEX_SCAN", "INDEX_ONLY_SCAN", "BITMAP_SCAN", "CLUSTERED_SCAN", "NONCLUSTERED_SCAN", "RANGE_SCAN")
JOINS = ("NESTED_LOOP", "HASH_JOIN", "MERGE_JOIN")


def _number(x: object) -> float | None:
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def _row(**kw: object) -> dict:
    return {"node_type": None, "operation": None, "table": None, "index": None, "condition": None, "startup_cost": None, "total_cost": None, "est_rows": None, "act_rows": None, "children": 0, "warning": None} | kw


def _flatten(root: object, read) -> Iterator[dict]:
    """Nodes of a tree, parents first: (data, parent, depth) on a stack, so that depth has no limit."""
    stack, n = [(root, None, 1)], 0
    while stack:
        data, parent, depth = stack.pop()
        row, kids = read(data)
        yield row | {"node_id": n, "parent_id": parent, "depth": depth, "children": len(kids)}
        stack += [(k, n, depth + 1) for k in reversed(kids)]
        n += 1


def _postgres(d: dict) -> tuple[dict, list]:
    kind = d.get("Node Type", "")
    condition = next((d[k] for k in ("Hash Cond", "Merge Cond", "Join Filter", "Index Cond", "Filter") if k in d), None)
    kids = [k for k in d.get("Plans") or [] if isinstance(k, dict)]
    if condition is None and kind == "Nested Loop":
        # A nested loop over an inner index scan is joined by that scan's condition.
        condition = next((k["Index Cond"] for k in kids if "Index Cond" in k), None)
    return _row(node_type=_PG.get(kind, kind), operation=kind, table=d.get("Relation Name"), index=d.get("Index Name"), condition=condition, startup_cost=_number(d.get("Startup Cost")), total_cost=_number(d.get("Total Cost")), est_rows=_number(d.get("Plan Rows")), act_rows=_number(d.get("Actual Rows"))), kids


def _mysql(d: dict) -> tuple[dict, list]:
    table = d.get("table") if isinstance(d.get("table"), dict) else {}
    access = table.get("access_type")
    kids = [k for k in d.get("nested_loop") or [] if isinstance(k, dict)]
    kids += [d[k] for k in ("ordering_operation", "grouping_operation", "duplicates_removal") if isinstance(d.get(k), dict)]
    kind = "NESTED_LOOP" if d.get("nested_loop") else _MYSQL.get(access, "SEQ_SCAN") if table else "OPERATION"
    cost = (d.get("cost_info") or table.get("cost_info") or {}).get("query_cost") or (table.get("cost_info") or {}).get("prefix_cost")
    joined = next((str(k["table"].get("ref") or k["table"].get("attached_condition")) for k in kids if isinstance(k.get("table"), dict) and (k["table"].get("ref") or k["table"].get("attached_condition"))), None)
    return _row(node_type=kind, operation=access or kind, table=table.get("table_name"), index=table.get("key"), condition=table.get("attached_condition") or joined, total_cost=_number(cost), est_rows=_number(table.get("rows_examined_per_scan"))), kids


_LINE = re.compile(r"^([\s|:+\-*]*)(?:\*?\((\d+)\) )?\s*(\w+)")


def _spark(text: str) -> Iterator[dict]:
    """The tree of ``explain()`` text: depth from indentation."""
    stack: list[tuple[int, int]] = []
    rows: list[dict] = []
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m or line.startswith("==") or m[3] in ("AdaptiveSparkPlan", "isFinalPlan"):
            continue
        indent, name = len(m[1]), m[3]
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1] if stack else None
        n = len(rows)
        table = re.search(r"(?:Location: \S+ \w+\(\d+ paths?\)\[|FileScan \w+ )(?:\S*/)?([\w.]+)", line)
        condition = re.search(r"Join \[(.*?)\], \[(.*?)\]|(?:NestedLoopJoin|CartesianProduct) .*?(\(.*\))", line)
        rows.append(_row(node_type=_SPARK.get(name, name.upper()), operation=name, table=table[1] if table and "Scan" in name else None, condition=f"{condition[1]} = {condition[2]}" if condition and condition[1] else condition[3] if condition else None, node_id=n, parent_id=parent, depth=len(stack) + 1))
        if parent is not None:
            rows[parent]["children"] += 1
        stack.append((indent, n))
    yield from rows


def _sqlite(text: str) -> Iterator[dict]:
    for n, line in enumerate(x for x in text.splitlines() if x.strip()):
        m = re.search(r"(SCAN|SEARCH)\s+(?:TABLE\s+)?(\w+)(?:.*USING (?:COVERING )?INDEX (\w+))?", line)
        yield _row(node_type=("FULL_TABLE_SCAN" if m[1] == "SCAN" and not m[3] else "INDEX_SCAN") if m else "OPERATION", operation=line.strip(" |`-"), table=m[2] if m else None, index=m[3] if m else None, node_id=n, parent_id=None, depth=1)


def _sqlserver(text: str) -> Iterator[dict]:
    """Operators (RelOp) of a showplan document, nested by position."""
    kinds = {"Table Scan": "TABLE_SCAN", "Clustered Index Scan": "CLUSTERED_SCAN", "Index Scan": "NONCLUSTERED_SCAN", "Clustered Index Seek": "INDEX_SCAN", "Index Seek": "INDEX_SCAN", "Nested Loops": "NESTED_LOOP", "Hash Match": "HASH_JOIN", "Merge Join": "MERGE_JOIN", "Sort": "SORT", "Stream Aggregate": "AGGREGATE"}
    stack: list[int] = []
    rows: list[dict] = []
    for m in re.finditer(r"<(/?)RelOp\b([^>]*)>|<Object\b([^>]*)/?>|<(?:Predicate|HashKeysProbe|OuterReferences|InnerSideJoinColumns)\b", text):
        if m[1]:
            stack = stack[:-1]
        elif m[2] is not None:
            at = dict(re.findall(r'(\w+)="([^"]*)"', m[2]))
            n = len(rows)
            rows.append(_row(node_type=kinds.get(at.get("PhysicalOp", ""), at.get("PhysicalOp", "").upper()), operation=at.get("PhysicalOp"), total_cost=_number(at.get("EstimatedTotalSubtreeCost")), est_rows=_number(at.get("EstimateRows")), node_id=n, parent_id=stack[-1] if stack else None, depth=len(stack) + 1))
            if stack:
                rows[stack[-1]]["children"] += 1
            if not m[2].endswith("/"):
                stack.append(n)
        elif m[3] is not None and stack:
            at = dict(re.findall(r'(\w+)="\[?([^"\]]*)\]?"', m[3]))
            rows[stack[-1]] |= {"table": at.get("Table"), "index": at.get("Index")}
        elif stack:
            rows[stack[-1]]["condition"] = rows[stack[-1]]["condition"] or "predicate"
    yield from rows


def nodes_of(plan: str, dialect: str) -> list[dict]:
    """Node rows of one plan; a plan that can't be read is one row with a warning."""
    try:
        if dialect in ("postgresql", "postgres"):
            data = json.loads(plan)
            data = data[0] if isinstance(data, list) else data
            return list(_flatten(data.get("Plan", data), _postgres))
        if dialect == "mysql":
            return list(_flatten(json.loads(plan)["query_block"], _mysql))
        if dialect == "spark":
            return list(_spark(plan))
        if dialect == "sqlite":
            return list(_sqlite(plan))
        if dialect in ("sqlserver", "mssql"):
            return list(_sqlserver(plan))
    except (ValueError, KeyError, TypeError, AttributeError, IndexError) as e:
        return [_row(node_id=0, parent_id=None, depth=1, warning=f"unreadable plan: {type(e).__name__}")]
    return [_row(node_id=0, parent_id=None, depth=1, warning=f"no plan format is known for {dialect}")]


def plan_nodes(plans: DataFrame) -> DataFrame:
    """Nodes of (plan_id, dialect, plan)."""
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r | {"plan_id": i} for i, d, p in zip(b["plan_id"], b["dialect"], b["plan"], strict=True) for r in nodes_of(p or "", (d or "").lower())]
            if rows:
                out = pd.DataFrame(rows)[names]
                yield out.astype({c: "Int64" for c in ("parent_id", "est_rows", "act_rows")} | {c: "Float64" for c in ("startup_cost", "total_cost")})

    return plans.select(F.col("plan_id").cast("string").alias("plan_id"), "dialect", "plan").mapInPandas(run, NODES)


def _is(kinds: tuple[str, ...]) -> Column:
    return F.coalesce(F.col("node_type").isin(*kinds), F.lit(False))


def statistics(nodes: DataFrame) -> DataFrame:
    """Counts of nodes, scans, joins and index uses, rows and depth of each plan."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return nodes.groupBy("plan_id").agg(
        F.count("*").alias("nodes"), n(_is(FULL_SCANS) | _is(INDEX_SCANS)).alias("scans"), n(_is(FULL_SCANS)).alias("full_scans"), n(_is(JOINS)).alias("joins"), n(_is(INDEX_SCANS)).alias("index_scans"),
        F.coalesce(F.sum("est_rows"), F.lit(0)).alias("est_rows"), F.max("depth").cast("long").alias("depth"), F.max(F.when(F.col("parent_id").isNull(), F.col("total_cost"))).alias("total_cost"),
    )


# Thresholds, severities and divisors of the rules.


def _rules(nodes: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    each = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), impact.cast("double").alias("impact"))) for kind, severity, when, impact in rules)))
    return nodes.select("plan_id", "node_id", "table", F.explode(each).alias("x")).select("plan_id", "node_id", "table", "x.*")


def bottlenecks(nodes: DataFrame) -> DataFrame:
    est, cost = F.col("est_rows"), F.col("total_cost")
    ratio = F.try_divide(F.col("act_rows"), est)
    return _rules(nodes, [
        ("FULL_SCAN", "WARNING", _is(FULL_SCANS) & (est > 1000), est / 1000),
        ("EXPENSIVE_OPERATION", "WARNING", cost > 1000, cost / 1000),
        ("NESTED_LOOP", "CRITICAL", _is(("NESTED_LOOP",)) & (est > 10000), est / 10000),
        ("BAD_ESTIMATE", "INFO", (F.col("act_rows") > 0) & ((ratio > 10) | (ratio < 0.1)), ratio),
    ])


def issues(nodes: DataFrame) -> DataFrame:
    est = F.col("est_rows")
    found = _rules(nodes, [
        ("MISSING_INDEX", "WARNING", _is(FULL_SCANS) & (est > 100), est / 1000),
        ("INEFFICIENT_JOIN", "WARNING", _is(("NESTED_LOOP",)) & (est > 5000), est / 5000),
        ("CARTESIAN_PRODUCT", "CRITICAL", _is(JOINS) & (F.coalesce("condition", F.lit("")) == "") & (F.col("children") >= 2), F.lit(10.0)),
        ("EXPENSIVE_SORT", "INFO", _is(("SORT",)) & (est > 10000), est / 10000),
    ])
    s, i = F.col("severity"), F.col("impact")
    return found.withColumn("priority", F.when((s == "CRITICAL") | (i > 5), "CRITICAL").when((s == "WARNING") | (i > 2), "HIGH").when((s == "INFO") | (i > 1), "MEDIUM").otherwise("LOW"))


def scores(nodes: DataFrame) -> DataFrame:
    """(plan_id, score): 100 less 20, 10 and 5 for critical, warning and informing issues and bottlenecks, 10 for a
    cost over 10,000, and 20 times the share of full scans; not under 0."""
    marks = issues(nodes).select("plan_id", "severity").unionByName(bottlenecks(nodes).select("plan_id", "severity"))
    lost = marks.groupBy("plan_id").agg(F.sum(F.when(F.col("severity") == "CRITICAL", 20).when(F.col("severity") == "WARNING", 10).otherwise(5)).alias("lost"))
    out = statistics(nodes).join(lost, "plan_id", "left")
    score = 100.0 - F.coalesce("lost", F.lit(0)) - F.when(F.col("total_cost") > 10000, 10).otherwise(0) - 20.0 * F.col("full_scans") / F.col("nodes")
    return out.select("plan_id", F.greatest(F.lit(0.0), score).alias("score"))


def spark_plan(df: DataFrame, plan_id: str = "plan") -> DataFrame:
    """The physical plan of a DataFrame as a row for ``plan_nodes``."""
    return df.sparkSession.createDataFrame([(plan_id, "spark", df._jdf.queryExecution().executedPlan().toString())], "plan_id string, dialect string, plan string")
