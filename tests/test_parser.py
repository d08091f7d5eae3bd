"""The parser: standard precedence, nothing dropped silently, dialects' quoting, and statements of every kind."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import dialects, shim
from quarry.plans import analysis
from quarry.plans.sqlparse import SqlError, parse, parse_script, tokens


def shown(sql, dialect="postgresql"):
    return analysis.render(parse(f"SELECT x FROM t WHERE {sql}", dialect).where)


@pytest.mark.parametrize(
    ("sql", "tree"),
    [
        ("a = 1 AND b = 2", "((a = 1) AND (b = 2))"), ("a + b * c = 1 OR d = 2 AND e = 3", "(((a + (b * c)) = 1) OR ((d = 2) AND (e = 3)))"), ("NOT a = 1 AND b", "((NOT (a = 1)) AND b)"), ("a BETWEEN 1 AND 2 AND b", "((a BETWEEN 1 AND 2) AND b)"),
        ("a NOT IN (1, 2)", "(a NOT IN (1, 2))"), ("a IS NOT NULL", "(a IS NOT NULL)"), ("a NOT LIKE 'x%'", "(a NOT LIKE 'x%')"), ("-a < 3 - -2", "((- a) < (3 - (- 2)))"), ("a || b = 'c'", "((a || b) = 'c')"), ("x::INT = 3", "(CAST(x AS INT) = 3)"),
    ],
)
def test_precedence(sql, tree):
    assert shown(sql) == tree


@pytest.mark.parametrize("sql", ["SELECT a FROM t WHERE x BETWEEN 1 AND 2 extra words here", "SELECT a FROM t LEFT JOIN u", "SELECT CASE END FROM t", "", "MERGE INTO t USING s ON a = b", "SELECT (1", "UPDATE t"])
def test_errors(sql):
    with pytest.raises(SqlError):
        parse(sql, "postgresql")


@pytest.mark.parametrize(
    ("dialect", "sql", "names"),
    [("sqlserver", "SELECT [a b].[c]]d] FROM [t]", ("a b", "c]d")), ("mysql", "SELECT `a b`.`c``d` FROM t", ("a b", "c`d")), ("postgresql", 'SELECT "a b"."c""d" FROM t', ("a b", 'c"d'))],
)
def test_quoting(dialect, sql, names):
    c = parse(sql, dialect).items[0].kids[0]
    assert (c.table, c.value) == names


def test_strings():
    assert parse("SELECT 'it''s'", "sqlserver").items[0].kids[0].value == "it's"
    assert parse(r"SELECT 'it\'s', " + '"x"', "mysql").items[1].kids[0].value == "x"
    assert parse("SELECT $q$it's$q$, $$a$$", "postgresql").items[0].kids[0].value == "it's"


KINDS = {
    "SELECT DISTINCT TOP 5 a, t.*, COUNT(DISTINCT b) OVER (PARTITION BY c ORDER BY d DESC NULLS LAST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM s.t AS t LEFT OUTER JOIN u USING (id) CROSS JOIN v WHERE EXISTS (SELECT 1 FROM w WHERE w.a = t.a) GROUP BY a HAVING COUNT(*) > 1 ORDER BY 1": "SELECT",
    "SELECT a FROM t UNION ALL SELECT b FROM u INTERSECT SELECT c FROM v ORDER BY 1 LIMIT 5 OFFSET 2": "SELECT",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT n FROM t": "SELECT",
    "WITH x AS (SELECT 1) DELETE FROM t WHERE a IN (SELECT 1 FROM x)": "DELETE",
    "INSERT INTO t (a, b) VALUES (1, 'x'), (2, DEFAULT) ON CONFLICT (a) DO UPDATE SET b = 'y' RETURNING a": "INSERT",
    "INSERT INTO t SELECT * FROM u": "INSERT", "UPDATE t SET a = a + 1, b = NULL WHERE c = 2 ORDER BY d LIMIT 3": "UPDATE", "DELETE FROM t WHERE a = 1": "DELETE",
    "MERGE INTO t USING (SELECT * FROM s) AS s ON t.id = s.id WHEN MATCHED AND s.x = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED BY SOURCE THEN DELETE WHEN NOT MATCHED THEN INSERT (id) VALUES (s.id)": "MERGE",
    "CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY, a DECIMAL(10,2) NOT NULL DEFAULT 0, b INT REFERENCES u(id) ON DELETE SET NULL, c TIMESTAMP WITH TIME ZONE, CONSTRAINT k UNIQUE (a, b), CHECK (a > 0), FOREIGN KEY (b) REFERENCES u (id) ON UPDATE CASCADE)": "CREATE TABLE",
    "DROP TABLE IF EXISTS t CASCADE": "DROP TABLE", "DROP MATERIALIZED VIEW v": "DROP MATERIALIZED VIEW", "ALTER TABLE t ADD COLUMN a INT": "ALTER TABLE", "ALTER TABLE t DROP COLUMN a": "ALTER TABLE", "ALTER TABLE t MODIFY COLUMN a BIGINT": "ALTER TABLE", "ALTER TABLE t CHANGE a b INT": "ALTER TABLE", "ALTER TABLE t ADD CONSTRAINT c PRIMARY KEY (a)": "ALTER TABLE",
    "CREATE UNIQUE INDEX i ON t (a, b DESC)": "CREATE INDEX", "CREATE OR REPLACE VIEW v (a) AS SELECT 1 WITH CHECK OPTION": "CREATE VIEW", "CREATE TRIGGER g BEFORE INSERT OR UPDATE ON t FOR EACH ROW WHEN (a > 1) BEGIN SELECT 1; END": "CREATE TRIGGER",
    "CREATE OR REPLACE PROCEDURE p(IN a INT, OUT b VARCHAR(10)) LANGUAGE SQL AS BEGIN DECLARE x INT DEFAULT 0; WHILE x < 3 DO SET x = x + 1; END WHILE; IF x = 3 THEN SELECT 1; ELSEIF x > 3 THEN SELECT 2; ELSE RETURN; END IF; END": "CREATE PROCEDURE",
    "CREATE FUNCTION f(a INT) RETURNS INT DETERMINISTIC BEGIN RETURN a * 2; END": "CREATE FUNCTION",
    "BEGIN TRANSACTION": "BEGIN", "COMMIT": "COMMIT", "ROLLBACK TO SAVEPOINT s": "ROLLBACK TO SAVEPOINT", "SAVEPOINT s": "SAVEPOINT", "RELEASE SAVEPOINT s": "RELEASE SAVEPOINT",
    "EXPLAIN (ANALYZE, FORMAT JSON) SELECT 1": "EXPLAIN", "EXPLAIN QUERY PLAN SELECT 1": "EXPLAIN", "BEGIN FOR i IN 1..10 LOOP SET x = i; EXIT WHEN i > 3; END LOOP; REPEAT SET y = 1; UNTIL y = 1 END REPEAT; EXCEPTION WHEN others THEN ROLLBACK; END": "SCRIPT",
    "CALL p(1, 'x')": "EXECUTE", "DECLARE c CURSOR FOR SELECT a FROM t": "DECLARE CURSOR", "FETCH ABSOLUTE 3 FROM c INTO x, y": "FETCH",
}


@pytest.mark.parametrize("sql", list(KINDS))
def test_kinds(sql):
    assert analysis.query_type(parse(sql, "postgresql")) == KINDS[sql]


def test_scripts():
    assert [n.kind for n in parse_script("SELECT 1; COMMIT; DELETE FROM t;", "mysql")] == ["select", "transaction", "delete"]


def test_token_places():
    t = tokens("SELECT a\n  FROM t -- x\n", "mysql")
    assert [(x.text, x.line, x.column) for x in t[:-1]] == [("SELECT", 1, 1), ("a", 1, 8), ("FROM", 2, 3), ("t", 2, 8)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.sampled_from(list(dialects.DIALECTS)))
def test_any_text_is_a_tree_or_an_error(sql, dialect):
    assert ("error" in analysis.analyze(sql, dialect)) and "".join(tokens(sql, dialect)[-1].text) == ""


def test_dialects():
    assert dialects.get("Postgres").name == "PostgreSQL" and dialects.get("nothing").name == "SQL Server"
    assert dialects.get("mysql").is_reserved("select") and not dialects.get("mysql").is_reserved("users")
    assert dialects.get("sqlserver").quote("a") == "[a]" and dialects.get("oracle").limit == "Oracle"
    assert dialects.compatible("int", "BIGINT") and not dialects.compatible("INT", "VARCHAR") and dialects.spark_type("NUMBER", precision=10, scale=2) == "decimal(10,2)"


def test_shim():
    assert shim.to_spark("SELECT TOP 3 [a] FROM (SELECT TOP 2 b FROM t) x", "sqlserver") == "SELECT `a` FROM ( SELECT b FROM t LIMIT 2 ) x LIMIT 3"
    assert shim.to_spark("SELECT a FROM t OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY", "sqlserver") == "SELECT a FROM t LIMIT 5 OFFSET 2"


@pytest.mark.parametrize(
    ("dialect", "sql", "kind"),
    [
        ("oracle", "CREATE FUNCTION f(a IN NUMBER, b IN OUT NUMBER) RETURN NUMBER IS c NUMBER := 1; BEGIN c := a * 2; RETURN c; END f;", "create function"),
        ("oracle", "CREATE OR REPLACE FUNCTION f RETURN VARCHAR2 AS BEGIN RETURN 'x'; END;", "create function"),
        ("postgresql", "DO $$ DECLARE x INT; BEGIN x := 1; END; $$ LANGUAGE plpgsql", "do"),
        ("oracle", "SELECT id, LEVEL FROM t START WITH up IS NULL CONNECT BY NOCYCLE PRIOR id = up ORDER SIBLINGS BY id", "select"),
        ("sqlserver", "RAISERROR('no', 16, 1)", "raiserror"),
    ],
)
def test_routines_blocks_and_hierarchies(dialect, sql, kind):
    assert parse(sql, dialect).kind == kind


def test_words_of_hierarchies_stay_names():
    assert parse("SELECT a start FROM t connect WHERE prior = 1", "mysql").kind == "select"
    assert parse("SELECT start.a FROM t start WHERE start.prior = 1", "oracle").kind == "select"


def test_trigger_body_ends_with_its_block():
    text = "CREATE TRIGGER g AFTER INSERT ON t FOR EACH ROW BEGIN IF 1 = 1 THEN UPDATE t SET a = CASE WHEN a > 1 THEN 2 END; END IF; END; SELECT 1 FROM u;"
    found = parse_script(text, "mysql")
    assert [n.kind for n in found] == ["create trigger", "select"] and found[0].attrs["body"].startswith("BEGIN IF") and found[0].attrs["body"].endswith("END IF; END")
    one = parse_script("CREATE TRIGGER g BEFORE DELETE ON t FOR EACH ROW SET @n = 1; SELECT 2", "mysql")
    assert one[0].attrs["body"] == "SET @n = 1" and one[1].kind == "select"
