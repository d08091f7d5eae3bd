"""TOP and ROWNUM as limits, files as statements, deep and many statements."""

from __future__ import annotations

import pytest

from quarry.functions import shim
from quarry.operators import dml
from quarry.plans import analysis
from quarry.plans.sqlparse import split_statements, tokens

REWRITES = [
    ("sqlserver", "SELECT TOP 3 a FROM t ORDER BY b", "SELECT a FROM t ORDER BY b LIMIT 3"),
    ("sqlserver", "SELECT DISTINCT TOP (4) a FROM t", "SELECT DISTINCT a FROM t LIMIT 4"),
    ("sqlserver", "SELECT TOP 3 a FROM t UNION ALL SELECT b FROM u", "( SELECT a FROM t LIMIT 3 ) UNION ALL SELECT b FROM u"),
    ("sqlserver", "SELECT TOP 1 a FROM t UNION SELECT TOP 2 b FROM u ORDER BY 1", "( SELECT a FROM t LIMIT 1 ) UNION ( SELECT b FROM u LIMIT 2 ) ORDER BY 1"),
    ("sqlserver", "SELECT a FROM t WHERE b = (SELECT TOP 1 c FROM u ORDER BY c) AND d = 1", "SELECT a FROM t WHERE b = ( SELECT c FROM u ORDER BY c LIMIT 1 ) AND d = 1"),
    ("oracle", "SELECT b FROM t WHERE ROWNUM <= 2 AND b = 1", "SELECT b FROM t WHERE b = 1 LIMIT 2"),
    ("oracle", "SELECT b FROM t WHERE ROWNUM = 1", "SELECT b FROM t LIMIT 1"),
    ("oracle", "SELECT COUNT(*) FROM t x WHERE ROWNUM < 5", "SELECT COUNT ( * ) FROM ( SELECT * FROM t x LIMIT 4 ) x"),
    ("oracle", "SELECT a FROM t WHERE c > 1 AND ROWNUM < 5 ORDER BY b", "SELECT a FROM ( SELECT * FROM t WHERE c > 1 LIMIT 4 ) t ORDER BY b"),
    ("oracle", "SELECT a FROM (SELECT a FROM t ORDER BY b) WHERE ROWNUM <= 5", "SELECT a FROM ( SELECT a FROM t ORDER BY b ) LIMIT 5"),
]


@pytest.mark.parametrize("dialect,sql,want", REWRITES)
def test_limits(dialect, sql, want):
    assert shim.to_spark(sql, dialect) == want


@pytest.mark.parametrize("dialect,sql", [
    ("oracle", "SELECT b FROM t WHERE b = 1 OR ROWNUM <= 2"),
    ("oracle", "SELECT b FROM t WHERE NOT (ROWNUM <= 2)"),
    ("oracle", "SELECT b FROM t WHERE ROWNUM > 2"),
    ("oracle", "SELECT ROWNUM FROM t"),
    ("oracle", "SELECT a FROM t, u WHERE ROWNUM < 5 ORDER BY a"),
    ("sqlserver", "SELECT TOP 5 PERCENT a FROM t"),
    ("sqlserver", "SELECT TOP 5 WITH TIES a FROM t"),
])
def test_no_counterpart_is_an_error(dialect, sql):
    with pytest.raises(ValueError):
        shim.to_spark(sql, dialect)


def test_with_ties(spark):
    spark.range(9).selectExpr("id", "id div 3 AS g").createOrReplaceTempView("ties")
    got = spark.sql(shim.to_spark("SELECT TOP 4 WITH TIES id FROM ties ORDER BY g", "sqlserver")).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 5]


def test_statements_of_a_file():
    assert split_statements("", "mysql") == [] and split_statements(" ;; -- x\n;", "mysql") == []
    assert split_statements("SELECT ';', \"a;b\" /* ; */ ; SELECT 2", "postgresql") == ["SELECT ';', \"a;b\" /* ; */", "SELECT 2"]
    body = "CREATE PROCEDURE p() BEGIN DECLARE x INT; IF x > 1 THEN SELECT CASE x WHEN 1 THEN 2 END; END IF; WHILE x < 3 DO SET x = x + 1; END WHILE; CASE x WHEN 1 THEN SELECT 1; END CASE; END"
    assert split_statements(f"{body}; SELECT 1;", "mysql") == [body, "SELECT 1"]
    oracle = "CREATE OR REPLACE PROCEDURE p IS x NUMBER; BEGIN x := 10 / 2; END"
    assert split_statements(f"{oracle};\n/\nSELECT 1 FROM dual\n/\n", "oracle") == [oracle, "SELECT 1 FROM dual"]
    assert split_statements("BEGIN; UPDATE t SET a = 1; COMMIT;", "postgresql") == ["BEGIN", "UPDATE t SET a = 1", "COMMIT"]


def test_deep_statements_are_rows(spark):
    """Thousands of conditions, parentheses and nested queries beside plain statements: no job fails."""
    long = "SELECT a FROM t WHERE " + " AND ".join(f"x{k} = {k}" for k in range(5000))
    deep = "SELECT " + "(" * 90_000 + "1"
    nested = "SELECT a FROM t WHERE b IN (" * 300 + "SELECT 1" + ")" * 300
    rows = [(1, "mysql", long), (2, "mysql", deep), (3, "mysql", nested), (4, "mysql", "SELECT 1"), (5, None, None)]
    got = {r.query_id: r for r in analysis.analyze_frame(spark.createDataFrame(rows, "query_id bigint, dialect string, sql string")).collect()}
    assert len(got[1].conditions) == 5000 and got[1].error is None and got[2].error and got[4].error is None and got[5].error and len(got) == 5
    assert len(got[3].tables) == 300


def test_parsing_is_dealt_to_tasks(spark):
    rows = [(k, "mysql", f"SELECT a{k} FROM t") for k in range(400)]
    frame = analysis.analyze_frame(spark.createDataFrame(rows, "query_id bigint, dialect string, sql string").repartition(1))
    assert "REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString() and frame.count() == 400


def test_token_places():
    got = [(t.text, t.line, t.column) for t in tokens("a\n  'x\ny' b -- c\nd", "mysql")]
    assert got == [("a", 1, 1), ("x\ny", 2, 3), ("b", 3, 4), ("d", 4, 1), ("", 4, 2)]


def test_overwrite_keeps_the_table_if_it_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    with pytest.raises(Exception, match="(?i)cast|number|invalid"):
        dml.overwrite(spark.read.parquet(path).selectExpr("CAST(concat('x', id) AS INT) AS id"), path)
    assert spark.read.parquet(path).count() == 5
    dml.overwrite(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.next").exists()
