"""Queries that change tables: DML, MERGE, DDL, constraints, scripts, transactions. Each returns the table afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog, dml, joins, scripts
from quarry.session import load_tables, table


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


_nation, _orders, _customer, _supplier = _t("nation"), _t("orders"), _t("customer"), _t("supplier")


def insert_values(spark: SparkSession, d: str) -> DataFrame:
    return dml.insert_values(_nation(spark, d), [(100, "ATLANTIS", 1), (101, "MU", None)])


def insert_columns(spark: SparkSession, d: str) -> DataFrame:
    return dml.insert_values(_nation(spark, d), [("ATLANTIS", 100)], ["n_name", "n_nationkey"])


def insert_select(spark: SparkSession, d: str) -> DataFrame:
    n = _nation(spark, d)
    return dml.insert_select(n, n.where("n_regionkey = 1").select(F.col("n_nationkey") + 1000, F.lower("n_name"), "n_regionkey"))


def update_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(_customer(spark, d), {"c_acctbal": "c_acctbal + 100", "c_mktsegment": "'VIP'"}, "c_acctbal > 9000")


def update_limit(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(_customer(spark, d), {"c_mktsegment": "'POOR'"}, "c_nationkey < 20", ["c_acctbal"], 25, ["c_custkey"])


def update_subquery(spark: SparkSession, d: str) -> DataFrame:
    big = _orders(spark, d).where("o_totalprice > 300000").select("o_custkey").distinct()
    c = _customer(spark, d).join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
    return dml.update(c, {"c_mktsegment": "'BIG'"}, "o_custkey IS NOT NULL").drop("o_custkey")


def delete_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete(_customer(spark, d), "NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY'")


def delete_exists(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_exists(_customer(spark, d), _orders(spark, d), "t.c_custkey = s.o_custkey AND s.o_totalprice > 250000")


def delete_limit(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete(_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus = 'F'", ["o_totalprice"], 30, ["o_orderkey"])


def _changes(spark: SparkSession, d: str) -> DataFrame:
    c = _customer(spark, d)
    return c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1000000)).alias("k"), (F.col("c_acctbal") + 1).alias("bal"), "c_nationkey")


_CHANGES = "(SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS k, c_acctbal + 1 AS bal, c_nationkey AS nk FROM customer WHERE c_custkey % 3 = 0)"
_TARGET = "(SELECT c_custkey, c_acctbal, c_nationkey FROM customer)"


def _target(spark: SparkSession, d: str) -> DataFrame:
    return _customer(spark, d).select("c_custkey", "c_acctbal", "c_nationkey")


_INSERT = dml.Clause("not_matched", "insert", None, {"c_custkey": "s.k", "c_acctbal": "s.bal", "c_nationkey": "s.c_nationkey"})


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return dml.merge(_target(spark, d), _changes(spark, d), "t.c_custkey = s.k", [dml.Clause("matched", "update", None, {"c_acctbal": "s.bal"}), _INSERT], ["c_custkey"])


def merge_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.merge(_target(spark, d), _changes(spark, d), "t.c_custkey = s.k", [dml.Clause("matched", "delete")], ["c_custkey"])


def merge_conditional(spark: SparkSession, d: str) -> DataFrame:
    clauses = [dml.Clause("matched", "delete", "s.bal < 0"), dml.Clause("matched", "update", "s.bal < 5000", {"c_acctbal": "t.c_acctbal * 2"}), dml.Clause("not_matched", "insert", "s.bal > 0", _INSERT.values)]
    return dml.merge(_target(spark, d), _changes(spark, d), "t.c_custkey = s.k", clauses, ["c_custkey"])


def merge_by_source(spark: SparkSession, d: str) -> DataFrame:
    clauses = [dml.Clause("not_matched_by_source", "delete", "t.c_acctbal < 0"), dml.Clause("not_matched_by_source", "update", None, {"c_acctbal": "0D"}), _INSERT]
    return dml.merge(_target(spark, d), _changes(spark, d), "t.c_custkey = s.k", clauses, ["c_custkey"])


def ddl_view(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW big_customers(k, name) AS SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
    return spark.sql("SELECT name, k FROM big_customers WHERE k % 2 = 0")


def ddl_alter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.alter_frame(_nation(spark, d), {"note": "string"}, ["n_regionkey"], {"n_name": "name"}, {"n_nationkey": "bigint"})


def ctas(spark: SparkSession, d: str) -> DataFrame:
    return _nation(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.foreign_key_violations(table(spark, d, "lineitem"), _orders(spark, d).where("o_orderstatus <> 'P'"), ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber")


def pk_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def script_while(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE i INT DEFAULT 0; DECLARE total BIGINT DEFAULT 0; WHILE i < 10 DO SET i = i + 1; SET total = total + i * i; END WHILE; SELECT total; END")


def script_if(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    return spark.sql("BEGIN DECLARE n BIGINT; SET n = (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P'); IF n > 1000000 THEN SELECT 'many' AS size; ELSEIF n > 0 THEN SELECT 'some' AS size; ELSE SELECT 'none' AS size; END IF; END")


def script_for(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    return spark.sql("BEGIN DECLARE longest BIGINT DEFAULT 0; FOR r AS SELECT r_name FROM region DO SET longest = greatest(longest, CAST(length(r.r_name) AS BIGINT)); END FOR; SELECT longest; END")


def script_loops(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE i INT DEFAULT 0; DECLARE n INT DEFAULT 0; outer_loop: LOOP SET i = i + 1; IF i > 9 THEN LEAVE outer_loop; END IF; IF i % 2 = 0 THEN ITERATE outer_loop; END IF; SET n = n + i; END LOOP; REPEAT SET n = n + 100; UNTIL n > 300 END REPEAT; SELECT n; END")


def script_case(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE k INT DEFAULT 2; CASE k WHEN 1 THEN SELECT 'one' AS word; WHEN 2 THEN SELECT 'two' AS word; ELSE SELECT 'other' AS word; END CASE; END")


def script_handler(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SELECT 'handled' AS outcome; END; SELECT 1 / 0; SELECT 'unreached' AS outcome; END")


def routine_procedure(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    r = scripts.Routines(spark)
    r.create_procedure("orders_over", ("least",), "SELECT o_orderkey FROM orders WHERE o_totalprice > :least")
    return r.call("orders_over", 300000)


def routine_function(spark: SparkSession, d: str) -> DataFrame:
    load_tables(spark, d)
    scripts.Routines(spark).create_function("net_price", {"price": "DOUBLE", "discount": "DOUBLE"}, "DOUBLE", "price * (1 - discount)")
    return spark.sql("SELECT l_orderkey, l_linenumber, ROUND(net_price(l_extendedprice, l_discount), 4) AS net FROM lineitem WHERE l_quantity > 49")


def cursor_scroll(spark: SparkSession, d: str) -> DataFrame:
    c = scripts.Cursor(_nation(spark, d).select("n_nationkey", "n_name"), ["n_nationkey"])
    moves = [("first", 1), ("next", 1), ("absolute", 5), ("relative", 3), ("prior", 1), ("last", 1)]
    rows = [(k, f"{w} {n}", r.n_nationkey, r.n_name) for k, (w, n) in enumerate(moves) if (r := c.fetch(w, n))]
    c.close()
    return spark.createDataFrame(rows, "step long, move string, n_nationkey int, n_name string")


def tx_savepoint(spark: SparkSession, d: str) -> DataFrame:
    tx = scripts.Transaction({"n": _nation(spark, d)})
    tx.tables["n"] = dml.delete(tx.tables["n"], "n_regionkey = 0")
    tx.savepoint("a")
    tx.tables["n"] = dml.delete(tx.tables["n"], "n_regionkey = 1")
    tx.savepoint("b")
    tx.tables["n"] = dml.delete(tx.tables["n"])
    tx.rollback("a")
    tx.tables["n"] = dml.update(tx.tables["n"], {"n_name": "lower(n_name)"}, "n_regionkey = 2")
    return tx.commit()["n"]


def tx_rollback(spark: SparkSession, d: str) -> DataFrame:
    tx = scripts.Transaction({"n": _nation(spark, d)})
    tx.tables["n"] = dml.delete(tx.tables["n"])
    tx.rollback()
    return tx.commit()["n"]


def range_binned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("value").alias("v"))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2.0).alias("lo"), (F.col("p_size") * 2.0 + 0.5).alias("hi"))
    return joins.range_join(e, p, F.col("v"), F.col("lo"), F.col("hi"), 4.0).select("event_id", "p_partkey")


def as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return joins.as_of(buys, views, ["user_id"], "ts", "seen", ["view_id"], bucket=86400.0).select("event_id", "view_id")


def salted(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("k"))
    return joins.salted_join(o, _customer(spark, d).select(F.col("c_custkey").alias("k"), "c_name"), "k").select("o_orderkey", "c_name")


def top_percent(spark: SparkSession, d: str) -> DataFrame:
    return joins.top_percent(_orders(spark, d).select("o_orderkey", "o_totalprice"), 2, [F.desc("o_totalprice"), "o_orderkey"])


def range_wide(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of very different widths: most touch a bin or two, some thousands."""
    e = table(spark, d, "events").select("event_id", F.col("value").alias("v"))
    wide = F.when(F.col("p_partkey") % 50 == 0, 200.0).otherwise(0.25)
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 3.0).alias("lo"), (F.col("p_size") * 3.0 + wide).alias("hi"))
    met = joins.range_join(e, p, F.col("v"), F.col("lo"), F.col("hi"), 0.5)
    return met.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


QUERIES = {
    "dml_insert_values": insert_values, "dml_insert_columns": insert_columns, "dml_insert_select": insert_select, "dml_update_where": update_where, "dml_update_limit": update_limit, "dml_update_subquery": update_subquery,
    "dml_delete_where": delete_where, "dml_delete_exists": delete_exists, "dml_delete_limit": delete_limit, "merge_upsert": merge_upsert, "merge_delete": merge_delete, "merge_conditional": merge_conditional, "merge_by_source": merge_by_source,
    "ddl_view": ddl_view, "ddl_alter_add_drop_rename": ddl_alter, "ddl_create_table_as": ctas, "constraint_fk_violations": fk_violations, "constraint_pk_duplicates": pk_duplicates,
    "script_while_sum": script_while, "script_if": script_if, "script_for": script_for, "script_loop_repeat": script_loops, "script_case": script_case, "script_exit_handler": script_handler, "routine_procedure": routine_procedure, "routine_function": routine_function, "cursor_scroll": cursor_scroll,
    "tx_rollback_to_savepoint": tx_savepoint, "tx_rollback": tx_rollback, "join_range_binned": range_binned, "join_range_wide": range_wide, "join_asof": as_of, "join_salted": salted, "top_percent": top_percent,
}

_MATCH = f"SELECT t.c_custkey, t.c_acctbal, t.c_nationkey, s.k, s.bal FROM {_TARGET} t LEFT JOIN {_CHANGES} s ON t.c_custkey = s.k"
_NEW = f"SELECT k AS c_custkey, bal AS c_acctbal, nk AS c_nationkey FROM {_CHANGES} s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.k)"
ORACLES = {
    "dml_insert_values": "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, 'MU', NULL",
    "dml_insert_columns": "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', NULL",
    "dml_insert_select": "SELECT * FROM nation UNION ALL SELECT n_nationkey + 1000, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1",
    "dml_update_where": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 9000 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal > 9000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "dml_update_limit": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20 ORDER BY c_acctbal, c_custkey LIMIT 25) THEN 'POOR' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "dml_update_subquery": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'BIG' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "dml_delete_where": "SELECT * FROM customer WHERE NOT coalesce(NULLIF(c_mktsegment, 'BUILDING') = 'MACHINERY', FALSE)",
    "dml_delete_exists": "SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "dml_delete_limit": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 30)",
    "merge_upsert": f"SELECT c_custkey, coalesce(bal, c_acctbal) AS c_acctbal, c_nationkey FROM ({_MATCH}) m UNION ALL {_NEW}",
    "merge_delete": f"SELECT c_custkey, c_acctbal, c_nationkey FROM ({_MATCH}) m WHERE k IS NULL",
    "merge_conditional": f"SELECT c_custkey, CASE WHEN bal < 5000 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_nationkey FROM ({_MATCH}) m WHERE bal IS NULL OR bal >= 0 UNION ALL SELECT * FROM ({_NEW}) n WHERE c_acctbal > 0",
    "merge_by_source": f"SELECT c_custkey, CASE WHEN k IS NULL THEN 0 ELSE c_acctbal END AS c_acctbal, c_nationkey FROM ({_MATCH}) m WHERE k IS NOT NULL OR c_acctbal >= 0 UNION ALL {_NEW}",
    "ddl_view": "SELECT c_name AS name, c_custkey AS k FROM customer WHERE c_acctbal > 5000 AND c_custkey % 2 = 0",
    "ddl_alter_add_drop_rename": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation",
    "ddl_create_table_as": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "constraint_fk_violations": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "constraint_pk_duplicates": "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
    "script_while_sum": "SELECT CAST(385 AS BIGINT) AS total",
    "script_if": "SELECT CASE WHEN COUNT(*) > 1000000 THEN 'many' WHEN COUNT(*) > 0 THEN 'some' ELSE 'none' END AS size FROM orders WHERE o_orderstatus = 'P'",
    "script_for": "SELECT MAX(length(r_name)) AS longest FROM region",
    "script_loop_repeat": "SELECT 325 AS n",
    "script_case": "SELECT 'two' AS word",
    "script_exit_handler": "SELECT 'handled' AS outcome",
    "routine_procedure": "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000",
    "routine_function": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 49",
    "cursor_scroll": "SELECT CAST(step AS BIGINT) AS step, move, n_nationkey, n_name FROM (VALUES (0, 'first 1', 1), (1, 'next 1', 2), (2, 'absolute 5', 5), (3, 'relative 3', 8), (4, 'prior 1', 7), (5, 'last 1', 25)) m(step, move, pos) JOIN (SELECT n_nationkey, n_name, ROW_NUMBER() OVER (ORDER BY n_nationkey) AS pos FROM nation) n USING (pos)",
    "tx_rollback_to_savepoint": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 0",
    "tx_rollback": "SELECT * FROM nation",
    "join_range_binned": "SELECT event_id, p_partkey FROM events JOIN part ON value >= p_size * 2.0 AND value <= p_size * 2.0 + 0.5",
    "join_range_wide": "SELECT p_partkey, COUNT(*) AS n, MIN(event_id) AS first_event FROM events JOIN part ON value >= p_size * 3.0 AND value <= p_size * 3.0 + CASE WHEN p_partkey % 50 = 0 THEN 200.0 ELSE 0.25 END GROUP BY p_partkey",
    "join_asof": "SELECT b.event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = b.user_id AND v.ts <= b.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id FROM events b WHERE b.event_type = 'purchase'",
    "join_salted": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "top_percent": "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders) t WHERE rn <= CEIL(n * 2 / 100.0)",
}
