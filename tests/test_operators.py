"""Changes, joins, scripts, sources, streams and alerts on small inputs."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, dml, joins, scripts
from quarry.plans import explain
from quarry.sources import config, logs, schema_files, sinks, tail
from quarry.streaming import alerts, monitor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_first_clause_wins_and_duplicates_fail(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, v int")
    s = spark.createDataFrame([(1, 5), (4, 40)], "id int, w int")
    clauses = [dml.Clause("matched", "update", "s.w > 7", {"v": "0"}), dml.Clause("matched", "update", None, {"v": "s.w + t.v"}), dml.Clause("not_matched", "insert", None, {"id": "s.id", "v": "s.w"})]
    assert sorted(dml.merge(t, s, "t.id = s.id", clauses, ["id"]).collect(), key=lambda r: r.id) == [(1, 15), (2, 20), (3, None), (4, 40)]
    twice = s.union(s)
    with pytest.raises(Exception, match="more than one source row"):
        dml.merge(t, twice, "t.id = s.id", clauses[:2], ["id"]).collect()


def test_merge_equals_semi_and_anti_joins(spark):
    t = spark.range(50).selectExpr("id", "id % 7 AS v")
    s = spark.range(25, 75).selectExpr("id", "id % 5 AS w")
    got = dml.merge(t, s, "t.id = s.id", [dml.Clause("matched", "update", None, {"v": "s.w"}), dml.Clause("not_matched", "insert", None, {"id": "s.id", "v": "s.w"})], ["id"])
    want = t.join(s, "id", "left_anti").union(s)
    assert rows(got) == rows(want)


def test_three_valued_delete(spark):
    t = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert dml.delete(t, "a > 2").count() == 2 and dml.delete(t, "NOT a > 2").count() == 2


def test_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    dml.overwrite(dml.delete(spark.read.parquet(path), "id < 2"), path)
    assert rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]


def test_range_join_each_pair_once(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 9.5), (3, None)], "i int, v double")
    b = spark.createDataFrame([(1, 0.0, 30.0), (2, 2.0, 2.0), (3, 5.0, 4.0)], "j int, lo double, hi double")
    assert rows(joins.range_join(a, b, F.col("v"), F.col("lo"), F.col("hi"), 3.0).select("i", "j")) == [(1, 1), (1, 2), (2, 1)]


def test_range_join_takes_wide_intervals_to_wider_bins(spark):
    a = spark.range(400).selectExpr("id AS i", "CAST(id * 13 % 997 AS DOUBLE) AS v")
    spans = [(1, 0.0, 0.0), (2, -1e9, 1e9), (3, 5.0, 70.0), (4, 100.0, 164.0), (5, 3.5, 3.9), (6, 7.0, 6.0), (7, None, 9.0), (8, 0.0, 996.0)]
    b = spark.createDataFrame(spans, "j int, lo double, hi double")
    got = joins.range_join(a, b, F.col("v"), F.col("lo"), F.col("hi"), 0.01)
    want = a.join(b, (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    assert rows(got.select("i", "j")) == rows(want.select("i", "j"))
    assert joins.range_join(a, b.limit(0), F.col("v"), F.col("lo"), F.col("hi"), 1.0).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_broadcasts_no_side(spark):
    left, right = spark.range(400).selectExpr("id % 50 AS k", "id"), spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    got = joins.salted_join(left, right, "k")
    assert rows(got.select("k", "id", "v")) == rows(left.join(right, "k").select("k", "id", "v"))
    plan = _plan(got)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_salted_join_repeats_only_hot_keys(spark):
    left = spark.range(400).selectExpr("IF(id < 300, 7, id) AS k", "id")
    right = spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    hot = joins._hot(left, "k", 100)
    assert rows(hot) == [(7,)]
    a, b = joins._dealt(left, right, "k", hot, 16)
    assert a.count() == 400 and b.count() == 500 + 15 and a.where("k = 7").select("_salt").distinct().count() == 16
    plan = _plan(joins.salted_join(left, right, "k", least=100))
    assert "SortMergeJoin" in plan and not re.search("BroadcastHashJoin.*Inner", plan)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("here", "there"), [("long", "int"), ("int", "long"), ("string", "string"), ("double", "double"), ("timestamp", "timestamp"), ("decimal(9,2)", "decimal(12,2)"), ("date", "date"), ("interval month", "interval month")])
def test_salted_join_equals_a_plain_one(spark, how, here, there):
    """Nulls, zeros of both signs, NaN, copies on both sides, keys of one side only, and keys of two types."""
    of = lambda n, kind: f"CAST({n} AS {kind})" if kind != "date" else f"date_add(DATE'2024-03-30', CAST({n} AS int))"
    key = lambda n, kind, zero: f"CASE WHEN {n} = 0 THEN CAST({zero} AS double) WHEN {n} = 1 THEN double('NaN') ELSE CAST({n} AS double) END" if kind == "double" else of(n, kind)
    left = spark.range(300).selectExpr(f"CASE WHEN id % 5 = 0 THEN NULL WHEN id < 150 THEN {key('id % 2', here, '-0.0D')} ELSE {key('id % 40', here, '0.0D')} END AS k", "id % 100 AS a")
    right = spark.range(60).selectExpr(f"CASE WHEN id % 9 = 8 THEN NULL ELSE {key('id % 30', there, '0.0D')} END AS k", "id AS b")
    want = left.join(right, "k", how)
    for least in (1, 10_000):
        got = joins.salted_join(left, right, "k", 4, how, least)
        assert got.schema.simpleString() == want.schema.simpleString()
        ours, theirs = (df.withColumn("k", F.col("k").cast("string")).collect() for df in (got, want))
        assert sorted(map(str, ours)) == sorted(map(str, theirs))


@pytest.mark.parametrize("kind", ["double", "timestamp", "timestamp_ntz", "int"])
def test_as_of_is_the_same_in_buckets(spark, kind):
    at = f"CAST(CAST({{}} AS TIMESTAMP) AS {kind})" if kind.startswith("timestamp") else f"CAST({{}} AS {kind})"
    left = spark.range(300).selectExpr("id", "id % 3 AS k", f"{at.format('id * 37 % 5000')} AS t").union(spark.sql(f"SELECT -1L, 0L, CAST(NULL AS {kind})"))
    right = spark.range(60).selectExpr("id % 4 AS k", f"{at.format('id * 911 % 4000')} AS s", "id AS r")
    plain, dealt = (rows(joins.as_of(left, right, ["k"], "t", "s", ["r"], bucket=b).select("id", F.coalesce("r", F.lit(-1)))) for b in (None, 100.0))
    assert plain == dealt and len(plain) == 301 and dict(plain)[-1] == -1
    brute = left.join(right, (left.k == right.k) & (right.s <= left.t), "left").groupBy("id").agg(F.max(F.struct("s", "r")).r.alias("r"))
    assert plain == rows(brute.select("id", F.coalesce("r", F.lit(-1))))


def test_transaction_and_cursor(spark):
    tx = scripts.Transaction({"t": spark.range(3)})
    tx.savepoint("a")
    tx.tables["t"] = spark.range(9)
    tx.savepoint("b")
    tx.rollback("a")
    assert [n for n, _ in tx.savepoints] == ["a"] and tx.commit()["t"].count() == 3
    c = scripts.Cursor(spark.range(100).repartition(7), ["id"])
    assert [c.fetch(w, n).id for w, n in [("next", 1), ("absolute", 40), ("relative", -2), ("prior", 1), ("last", 1), ("first", 1)]] == [0, 39, 37, 36, 99, 0]
    assert c.fetch("absolute", 101) is None and c.fetch("prior").id == 99
    c.close()


def test_constraints(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 3)], "a int, b int")
    assert rows(catalog.key_duplicates(df, ["a"])) == [(1, 2)] and rows(catalog.not_null_violations(df, ["a", "b"])) == [("b", 1)]


def test_schema_and_config(spark, tmp_path):
    doc = {"tables": [{"name": "T", "columns": [{"name": "Id", "type": "int", "primary_key": True}]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    (tmp_path / "s.yaml").write_text("tables:\n- name: T\n  columns:\n  - {name: Id, type: int, primary_key: true}\n")
    for f in ("s.json", "s.yaml"):
        assert rows(schema_files.load(spark, f"file://{tmp_path}/{f}").columns_frame(spark).select("table", "column", "type", "nullable", "is_pk")) == [("t", "id", "INT", False, True)]
    assert config.load('{"parser": {"dialect": "mysql"}}')["parser"]["max_query_size"] == 1_000_000
    with pytest.raises(ValueError, match="unknown output"):
        config.load("output: {format: xml}")
    assert config.load(config.dump(config.DEFAULTS, "yaml"), "yaml") == config.DEFAULTS


def test_log_shapes(spark):
    lines = ["2024-01-15T10:30:45.123Z  Query  SELECT 1", "2024-01-15T10:30:45.123Z 12 Query  UPDATE t SET a = 1", "x LOG:  statement: DELETE FROM t", "2024 exec sp_who", "select * from t", "nothing here", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "value string").select(logs.extract_query(F.col("value"))).collect()]
    assert got == ["SELECT 1", "UPDATE t SET a = 1", "DELETE FROM t", "sp_who", "select * from t", None, None]
    assert rows(logs.metrics(logs.parse_lines(spark.createDataFrame([("zzz",)], "value string")))) == [(0, 0.0, 0, 0, 0, 0)]


def test_tail_follows_whole_lines(spark, tmp_path):
    log, out = tmp_path / "q.log", []
    log.write_text("SELECT 1\nSELECT 2\nSEL")
    q = tail.follow(spark, str(log)).writeStream.foreachBatch(lambda b, n: out.extend(r.value for r in b.orderBy("pos").collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert out == ["SELECT 1", "SELECT 2"]
        with log.open("a") as f:
            f.write("ECT 3\n")
        q.processAllAvailable()
        assert out[2:] == ["SELECT 3"]
        log.write_text("NEW\n")
        q.processAllAvailable()
        assert out[3:] == ["NEW"]
    finally:
        q.stop()
    assert tail.TailReader({"path": str(log), "lines": "1"}).initialOffset() == {"pos": 0, "turn": 0}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"SELECT * FROM t{i} WHERE a = {i} /* duration: {i * 400} ms */" for i in range(6)] + ["DELETE FROM t", "SELECT FROM"]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n")
    batch = monitor.processed(spark.read.text(str(tmp_path / "in")))
    stream = monitor.processed(spark.readStream.text(str(tmp_path / "in")))
    q = monitor.statistics(stream).writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("stats")) == rows(monitor.statistics(batch)) == [(8, 3, 7, 0, 0, 1, 6.0)]
    found = rows(alerts.AlertManager().alerts(batch).groupBy("type", "level").count())
    assert found == [("FULL_SCAN", "ERROR", 1), ("PARSE_ERROR", "WARNING", 1), ("SLOW_QUERY", "ERROR", 1), ("SLOW_QUERY", "WARNING", 2)] or ("FULL_SCAN", "ERROR", 1) in found


def test_alert_levels(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.05, 0.5, 1.0, 2.5, 10.0)], "d double").select(alerts.slow_level(F.col("d"), 1.0)).collect()]
    assert got == [None, None, "WARNING", "ERROR", "CRITICAL"]


def test_plan_formats():
    xml = '<RelOp PhysicalOp="Nested Loops" EstimateRows="9000" EstimatedTotalSubtreeCost="2"><RelOp PhysicalOp="Table Scan" EstimateRows="500" EstimatedTotalSubtreeCost="1"><Object Table="[a]" /></RelOp><RelOp PhysicalOp="Index Seek" EstimateRows="1"><Object Table="[b]" Index="[i]" /></RelOp></RelOp>'
    n = explain.nodes_of(xml, "sqlserver")
    assert [(x["node_type"], x["parent_id"], x["table"]) for x in n] == [("NESTED_LOOP", None, None), ("TABLE_SCAN", 0, "a"), ("INDEX_SCAN", 0, "b")]
    assert [x["node_type"] for x in explain.nodes_of("SCAN users\nSEARCH orders USING INDEX i (a=?)", "sqlite")] == ["FULL_TABLE_SCAN", "INDEX_SCAN"]
    assert explain.nodes_of("{}", "oracle")[0]["warning"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    sinks.write(df, f"file://{tmp_path}/c", "csv")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).first().b == "[1,2]" and "|  a|" in sinks.as_table(df)


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    assert main(["--sql", "SELECT * FROM t", "--dialect", "mysql"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["analysis"]["query_type"] == "SELECT" and {s["type"] for s in out["suggestions"]} == {"SELECT_STAR", "MISSING_WHERE", "OVERPRIVILEGED_SELECT"}
    (tmp_path / "a.log").write_text("2024-01-01 10:30:45.123 SQL:BatchCompleted SELECT 1 Duration: 150 ms CPU: 75 ms Reads: 1 Writes: 0\n")
    assert main(["--log", f"file://{tmp_path}/a.log", "--output", "csv"]) == 0
    assert "SELECT,1" in capsys.readouterr().out


def test_command_line_gives_all_entries(spark, tmp_path, capsys):
    from quarry.__main__ import main

    n = 1234
    (tmp_path / "b.log").write_text("".join(f"2024-01-01 10:30:45.123 SQL:BatchCompleted SELECT {i} Duration: 150 ms CPU: 75 ms Reads: 1 Writes: 0\n" for i in range(n)))
    for kind in ("json", "csv"):
        assert main(["--log", f"file://{tmp_path}/b.log", "--output", kind]) == 0
        out = capsys.readouterr().out
        assert all(f"SELECT {i}" in out for i in (0, n - 1)) and sum("SELECT " in x for x in out.splitlines()) == n
