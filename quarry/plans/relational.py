"""The SQL surface as named queries.

A query is a text that Spark and DuckDB both run, or a pair of texts where their dialects differ. Each one is left
to Catalyst as it stands: filters and columns reach the scans, joins are planned by size. Averages are floored with a
small margin, since the engines break rounding ties differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import load_tables

Query = str | tuple[str, str]

EXPRESSIONS: dict[str, Query] = {
    "project_alias": "SELECT n_nationkey, upper(n_name) AS n FROM nation",
    "select_star": "SELECT * FROM region",
    "select_qualified_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "select_without_from": "SELECT 1 AS one, 'x' AS s, CAST(NULL AS INT) AS nothing, CAST(1.5 AS DOUBLE) AS d",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "filter_and_or": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05 OR l_returnflag = 'R' AND l_tax = 0",
    "filter_not": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 1000)",
    "filter_compare_all": "SELECT p_partkey, p_size FROM part WHERE p_size = 7 OR (p_size <> 9 AND p_size < 12 AND p_size > 3 AND p_size <= 11 AND p_size >= 4 AND p_size != 6)",
    "arith_precedence": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_tax * 2, 4) AS v, CAST(l_linenumber % 3 AS INT) AS r, -l_linenumber AS neg FROM lineitem WHERE l_extendedprice / 2 - 1 > 20000",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%S%' AND p_brand LIKE 'Brand#1_'",
    "filter_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_is_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' WHERE o.o_orderkey IS NULL",
    "filter_is_not_null": "SELECT event_id FROM events WHERE NULLIF(event_type, 'view') IS NOT NULL",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s FROM orders",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_nested": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'F1' ELSE 'F0' END ELSE 'X' END AS k FROM orders",
    "case_without_else": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 END AS p FROM orders",
    "case_in_group_by": "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS band, COUNT(*) AS n FROM orders GROUP BY CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END",
    "case_in_order_by": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 50",
    "fn_string": "SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS a, substring(c_name, 1, 8) AS b, upper(c_name) AS u, lower(c_name) AS l, trim(concat('  ', c_mktsegment, ' ')) AS t, replace(c_name, 'Customer', 'C') AS r, CAST(length(c_name) AS BIGINT) AS n, c_name || '!' AS e FROM customer",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, CAST(o_orderdate AS DATE) AS dt FROM orders",
    "fn_date_add": ("SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 30) AS later, date_sub(CAST(o_orderdate AS DATE), 7) AS earlier FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate AS DATE) - 7 AS earlier FROM orders"),
    "fn_math": "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(c_custkey % 7 AS BIGINT) AS m FROM customer",
    "fn_null": "SELECT event_id, coalesce(NULLIF(event_type, 'view'), 'none') AS t, NULLIF(user_id, 1) AS u FROM events",
    "fn_array": ("SELECT vec_id, size(embedding) AS n, ROUND(CAST(element_at(embedding, 1) AS DOUBLE), 4) AS first, ROUND(CAST(array_max(embedding) AS DOUBLE), 4) AS most, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings", "SELECT vec_id, len(embedding) AS n, ROUND(CAST(embedding[1] AS DOUBLE), 4) AS first, ROUND(CAST(list_max(embedding) AS DOUBLE), 4) AS most, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings"),
    "fn_map": ("SELECT l_orderkey, map_from_arrays(array_agg(l_linenumber), array_agg(l_quantity)) IS NOT NULL AS made, size(array_distinct(array_agg(l_returnflag))) AS flags, array_join(array_sort(collect_set(l_linestatus)), '+') AS states FROM (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS l_quantity, 'x' AS l_returnflag, 'y' AS l_linestatus FROM lineitem) t GROUP BY l_orderkey", "SELECT l_orderkey, TRUE AS made, 1 AS flags, 'y' AS states FROM lineitem GROUP BY l_orderkey"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "fn_cast": "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z, CAST(o_orderkey AS STRING) AS s FROM orders",
    "fn_regexp": ("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, p_name RLIKE '^[a-z]' AS low FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_matches(p_name, '^[a-z]') AS low FROM part"),
}

JOINS: dict[str, Query] = {
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "join_full": "SELECT a.n_name AS a, b.s_name AS b FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > 0",
    "join_left_outer": "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 1",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma_where": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_theta": "SELECT n.n_name, s.s_suppkey FROM nation n JOIN supplier s ON s.s_acctbal > n.n_nationkey * 400",
    "join_using": "SELECT n_nationkey, a.n_name FROM nation a JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) b USING (n_nationkey)",
    "join_natural": "SELECT n_name, x FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name AS x FROM region) r",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": "SELECT r.r_name, n.n_name, COUNT(*) AS n, ROUND(SUM(l.l_quantity), 2) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_acctbal > 0 GROUP BY r.r_name, n.n_name",
    "join_derived_table": "SELECT c.c_custkey, t.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_semi_exists": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "join_anti_not_exists": "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 40)",
    "join_anti_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "join_lateral": "SELECT n.n_name, t.s_suppkey FROM nation n, LATERAL (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000) t",
}

AGGREGATES: dict[str, Query] = {
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, FLOOR(AVG(o_totalprice) * 100 + 1e-6) / 100 AS a FROM orders",
    "agg_empty": "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS k, MAX(o_totalprice) AS hi FROM orders WHERE o_totalprice < 0",
    "agg_group": "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus",
    "agg_group_expr": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate)",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filtered_case": "SELECT l_linestatus, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, COUNT(CASE WHEN l_quantity > 25 THEN 1 END) AS big FROM lineitem GROUP BY l_linestatus",
    "agg_filter_clause": "SELECT l_linestatus, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus",
    "agg_string_list": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_rollup": "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_quantile": ("SELECT o_orderstatus, FLOOR(percentile(o_totalprice, 0.5) * 100 + 1e-6) / 100 AS med FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, FLOOR(quantile_cont(o_totalprice, 0.5) * 100 + 1e-6) / 100 AS med FROM orders GROUP BY o_orderstatus"),
    "agg_bool": ("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey"),
    "q1_pricing": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, FLOOR(SUM(l_extendedprice * (1 - l_discount)) + 1e-4) AS sum_disc, FLOOR(AVG(l_quantity) * 100 + 1e-6) / 100 AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "q6_revenue": "SELECT FLOOR(SUM(l_extendedprice * l_discount) + 1e-4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "customer_orders": """SELECT c.c_custkey, c.c_name, n.n_name, COUNT(o.o_orderkey) AS total_orders, ROUND(SUM(o.o_totalprice), 2) AS total_spent,
  FLOOR(AVG(o.o_totalprice) * 100 + 1e-6) / 100 AS avg_order_value, CAST(MAX(o.o_orderdate) AS DATE) AS last_order_date
FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON c.c_custkey = o.o_custkey
WHERE c.c_acctbal >= 0 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
GROUP BY c.c_custkey, c.c_name, n.n_name HAVING COUNT(o.o_orderkey) > 5 ORDER BY total_spent DESC, c.c_custkey""",
}

_RN = "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
WINDOWS: dict[str, Query] = {
    "win_row_number": f"SELECT o_orderkey, CAST({_RN} AS BIGINT) AS rn FROM orders",
    "win_rank_dense": "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part",
    "win_percent_rank": "SELECT p_partkey, FLOOR(PERCENT_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) * 1000000 + 1e-3) AS pr, FLOOR(CUME_DIST() OVER (PARTITION BY p_brand ORDER BY p_size) * 1000000 + 1e-3) AS cd FROM part",
    "win_ntile": "SELECT p_partkey, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS q FROM part",
    "win_lag_lead": "SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, LEAD(o_orderkey, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_first_last": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders",
    "win_running_sum": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "win_single_bound": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING) AS n FROM orders",
    "win_moving_avg_rows": "SELECT o_orderkey, FLOOR(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 100 + 1e-4) AS a FROM orders",
    "win_rows_following": "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS m FROM orders",
    "win_rows_offset_preceding": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 5 PRECEDING) AS n FROM orders",
    "win_range_unbounded": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part",
    "win_range_offset": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part",
    "win_partition_agg": "SELECT s_suppkey, COUNT(*) OVER (PARTITION BY s_nationkey) AS n, MIN(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo FROM supplier",
    "win_topn_per_group": f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, {_RN} AS rn FROM orders) t WHERE rn <= 3",
    "win_gaps_islands": ("SELECT user_id, MIN(d) AS first_day, MAX(d) AS last_day, COUNT(*) AS days FROM (SELECT user_id, d, date_sub(d, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY d) AS INT)) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, g", "SELECT user_id, MIN(d) AS first_day, MAX(d) AS last_day, COUNT(*) AS days FROM (SELECT user_id, d, d - CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, g"),
    "win_pct_change": "SELECT o_orderkey, FLOOR(1000 * (o_totalprice - p) / p + 1e-6) AS pct FROM (SELECT o_orderkey, o_totalprice, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) t WHERE p > 0",
    "win_year_to_date": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS ytd FROM orders",
    "win_ignore_nulls": ("SELECT event_id, LAST_VALUE(NULLIF(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events", "SELECT event_id, LAST_VALUE(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events"),
}

SETS: dict[str, Query] = {
    "sort_multi": "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC NULLS LAST, p_size ASC NULLS FIRST, p_partkey",
    "limit_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_mixed_precedence": "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier",
    "setop_order_by": "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation ORDER BY n LIMIT 12",
    "setop_in_derived": "SELECT COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) t",
    "cte_simple": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_multi": "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE n > 10) SELECT c.c_name, b.n FROM b JOIN customer c ON c.c_custkey = b.o_custkey",
    "cte_columns": "WITH t(k, v) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, v FROM t WHERE k < 5",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t",
    "cte_recursive_tree": "WITH RECURSIVE t(lvl, k, name) AS (SELECT 1, r_regionkey, r_name FROM region UNION ALL SELECT t.lvl + 1, n.n_nationkey, n.n_name FROM t JOIN nation n ON n.n_regionkey = t.k AND t.lvl = 1) SELECT lvl, k, name FROM t",
    "subq_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 2 * AVG(o_totalprice) FROM orders)",
    "subq_scalar_select": "SELECT r_name, (SELECT COUNT(*) FROM nation) AS nations FROM region",
    "subq_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.5 * AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "subq_correlated_select": "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "subq_nested3": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
    "subq_derived": "SELECT AVG_N.band, COUNT(*) AS n FROM (SELECT o_custkey, COUNT(*) % 5 AS band FROM orders GROUP BY o_custkey) AVG_N GROUP BY AVG_N.band",
    "subq_exists_or": "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)",
}

ALL: dict[str, Query] = EXPRESSIONS | JOINS | AGGREGATES | WINDOWS | SETS


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load_tables(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES = {name: sql_query(q if isinstance(q, str) else q[0]) for name, q in ALL.items()}
ORACLES = {name: q if isinstance(q, str) else q[1] for name, q in ALL.items()}
