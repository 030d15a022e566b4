"""The dialect's operators as queries over the supplied tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Session

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)
PRICING = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_extendedprice) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"

#: key: the query, or the query in the dialect and in the SQL of the oracle where they differ
QUERIES: dict[str, str | tuple[str, str]] = {
    "pricing": PRICING,
    "filter_not_equal": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey != 2",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE '_ed%'",
    "filter_in_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A','R')",
    "filter_not": "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND p_brand NOT IN ('Brand#1', 'Brand#11') AND p_name NOT LIKE '%a%'",
    "filter_null": "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL",
    "filter_constant": "SELECT r_name FROM region WHERE 1 = 1 AND 5 > r_regionkey",
    "filter_columns": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey",
    "filter_dangling": ("SELECT n_name FROM nation WHERE AND n_regionkey > 1 OR", "SELECT n_name FROM nation WHERE n_regionkey > 1"),
    "select_star": "SELECT * FROM region",
    "select_table_star": "SELECT n.* FROM nation n",
    "arith_projection": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity * 2 > 98",
    "int_division": "SELECT p_partkey, p_size / 2 AS h FROM part",
    "distinct_pairs": "SELECT DISTINCT p_brand, p_type FROM part",
    "join_inner": "SELECT c.c_custkey AS c_custkey, n.n_name AS n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "join_left": "SELECT n.n_name AS n_name, s.s_name AS s_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey",
    "join_right": "SELECT n.n_name AS n_name, s.s_name AS s_name FROM supplier s RIGHT OUTER JOIN nation n ON n.n_nationkey = s.s_nationkey",
    "join_full": "WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM c FULL JOIN o ON c.c_custkey = o.o_custkey",
    "join_cross": "SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n",
    "join_multi": "SELECT c.c_custkey AS c_custkey, r.r_name AS r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 1 AND c.c_acctbal > 0",
    "self_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "group_agg": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS n_tax, SUM(l_quantity) AS sum_qty, MIN(l_shipdate) AS first_ship, MAX(l_discount) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1",
    "group_only": "SELECT p_brand FROM part GROUP BY p_brand",
    "global_agg_empty": "SELECT COUNT(*) AS n, MAX(p_size) AS most FROM part WHERE p_size > 100000",
    "sum_int": (
        "SELECT p_brand, SUM(p_size) AS s FROM part GROUP BY p_brand",
        "SELECT p_brand, SUM(CAST(p_size AS DOUBLE)) AS s FROM part GROUP BY p_brand",
    ),
    "sum_expr": (
        "SELECT l_returnflag, SUM(l_quantity * l_linenumber) AS rev FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, SUM(l_quantity * l_linenumber) AS rev FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_arithmetic": "SELECT p_brand, MAX(p_size) - MIN(p_size) AS spread FROM part GROUP BY p_brand",
    "having_alias_order": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 ORDER BY n DESC, o_custkey LIMIT 20",
    "having_hidden_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "having_row_filter": (
        "SELECT n_nationkey FROM nation HAVING n_nationkey > 20",
        "SELECT n_nationkey FROM nation WHERE n_nationkey > 20",
    ),
    "count_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "date_filter": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01'",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'",
    ),
    "string_concat": ("SELECT s_suppkey, s_name + '-x' AS t FROM supplier", "SELECT s_suppkey, s_name || '-x' AS t FROM supplier"),
    "string_functions": (
        "SELECT UPPER(n_name) AS u, LOWER(n_name) AS l, LEN(n_name) AS n FROM nation",
        "SELECT upper(n_name) AS u, lower(n_name) AS l, length(n_name)::INT AS n FROM nation",
    ),
    "safe_divide": (
        "SELECT l_orderkey, l_linenumber, l_quantity / l_discount AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_quantity / NULLIF(l_discount, 0) AS d FROM lineitem",
    ),
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "offset_then_limit": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 LIMIT 10",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    ),
    "order_hidden": "SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 7",
    "union_distinct": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier",
    "union_all_mixed": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION SELECT r_regionkey FROM region",
    "union_tail": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 8",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "in_union_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT r_regionkey FROM region)",
    "exists": "SELECT n_name FROM nation WHERE EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey = 3)",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT r_regionkey FROM region WHERE r_name = 'NOPE')",
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
    "rank_window": "SELECT s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier",
    "rank_global": "SELECT n_nationkey, RANK() OVER (ORDER BY n_regionkey) AS r FROM nation",
    "cte_rank_top1": "WITH ranked AS (SELECT s_nationkey, s_name, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rk FROM supplier) SELECT s_nationkey, s_name FROM ranked WHERE rk = 1",
    "cte_chain": "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, COUNT(*) AS n FROM a GROUP BY n_regionkey) SELECT r.r_name AS r_name, b.n AS n FROM b JOIN region r ON b.n_regionkey = r.r_regionkey",
    "no_from": ("SELECT 1 + 2 AS three, 'a' + 'b' AS ab", "SELECT 3 AS three, 'ab' AS ab"),
    "rank_distinct_cut": (
        "SELECT DISTINCT s_nationkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_nationkey) AS r FROM supplier ORDER BY s_nationkey DESC OFFSET 2 LIMIT 5",
        "SELECT DISTINCT s_nationkey, 1::BIGINT AS r FROM supplier ORDER BY s_nationkey DESC LIMIT 5 OFFSET 2",
    ),
    "rank_after_filter": "SELECT s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS r FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 12",
    "order_of_application": "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand HAVING COUNT(*) > 5 ORDER BY n DESC, p_brand LIMIT 7 OFFSET 3",
    "having_alias_everywhere": (
        "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING n IN (70, 75, 80, 85) OR n BETWEEN 60 AND 69 OR p_brand LIKE '%2'",
        "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) IN (70, 75, 80, 85) OR COUNT(*) BETWEEN 60 AND 69 OR p_brand LIKE '%2'",
    ),
    "comparison_as_value": "SELECT p_partkey, p_size > 25 AS big FROM part",
    "truth_of_numbers": ("SELECT p_partkey FROM part WHERE p_size - 10", "SELECT p_partkey FROM part WHERE p_size - 10 <> 0"),
    "minus": "SELECT p_partkey, p_size - 1 AS less, p_retailprice - p_size AS rest FROM part",
    "events_top": "SELECT event_type, COUNT(*) AS n, MAX(value) AS most FROM events GROUP BY event_type",
}

PART = "CREATE TABLE t (p_partkey BIGINT PRIMARY KEY, p_brand VARCHAR(20), p_size INT DEFAULT 7)"
#: key: statements after a copy of part was stored as table t, the query, the oracle's SQL
CHANGES = {
    "dml_update": (
        "UPDATE t SET p_size = p_size + 100 WHERE p_size > 25",
        "SELECT p_partkey, p_size FROM t",
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS p_size FROM part",
    ),
    "dml_delete": (
        "DELETE FROM t WHERE p_size IN (SELECT p_size FROM t WHERE p_partkey < 20)",
        "SELECT p_partkey FROM t",
        "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_partkey < 20)",
    ),
    "dml_insert_default": (
        "INSERT INTO t (p_partkey, p_brand) VALUES (-1, 'new'), (-2, 'new')",
        "SELECT p_partkey, p_size FROM t",
        "SELECT p_partkey, p_size FROM part UNION ALL VALUES (-1::BIGINT, 7::INTEGER), (-2::BIGINT, 7::INTEGER)",
    ),
    "dml_transaction": (
        "BEGIN; DELETE FROM t WHERE p_size > 10; INSERT INTO t VALUES (-1, 'x', 1); ROLLBACK; BEGIN; DELETE FROM t WHERE p_size <= 10; COMMIT",
        "SELECT p_partkey FROM t",
        "SELECT p_partkey FROM part WHERE p_size > 10",
    ),
    "alter_add_column": (
        "ALTER TABLE t ADD COLUMN flag INT DEFAULT 3",
        "SELECT p_partkey, flag FROM t",
        "SELECT p_partkey, 3 AS flag FROM part",
    ),
    "alter_drop_column": ("ALTER TABLE t DROP COLUMN p_brand; VACUUM t", "SELECT * FROM t", "SELECT p_partkey, p_size FROM part"),
    "alter_modify_column": (
        "ALTER TABLE t MODIFY COLUMN p_size VARCHAR(1)",
        "SELECT p_partkey, p_size FROM t",
        "SELECT p_partkey, substr(p_size::VARCHAR, 1, 1) AS p_size FROM part",
    ),
    "dml_rejected_rows": (
        "INSERT INTO t VALUES (1, 'twice', 1), (-5, 'new', 2), (-5, 'again', 3), (NULL, 'none', 4), ('x', 'text', 5), (-6, 'half', 2.5)",
        "SELECT p_partkey, p_size FROM t",
        "SELECT p_partkey, p_size FROM part UNION ALL VALUES (-5::BIGINT, 2::INTEGER)",
    ),
    "dml_foreign_keys": (
        "CREATE TABLE c (Id INT PRIMARY KEY, P BIGINT REFERENCES t(p_partkey), U VARCHAR UNIQUE); INSERT INTO c VALUES (1, 1, 'a'), (2, -9, 'b'), (3, NULL, 'c'), (4, 2, 'a'), (5, 2, NULL)",
        "SELECT Id AS id, P AS p FROM c",
        "SELECT * FROM (VALUES (1::INTEGER, 1::BIGINT), (3, NULL), (5, 2)) x(id, p)",
    ),
    "dml_cascade": (
        "CREATE TABLE c (Id INT PRIMARY KEY, P BIGINT REFERENCES t(p_partkey) ON DELETE CASCADE); INSERT INTO c VALUES (1, 1), (2, 2), (3, NULL); DELETE FROM t WHERE p_partkey = 1",
        "SELECT p_partkey AS k FROM t UNION ALL SELECT Id FROM c",
        "SELECT p_partkey AS k FROM part WHERE p_partkey <> 1 UNION ALL VALUES (2), (3)",
    ),
    "drop_and_create": (
        "DROP TABLE t; CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2)",
        "SELECT a FROM t",
        "SELECT * FROM (VALUES (1::INTEGER), (2)) x(a)",
    ),
    "drop_index": (
        "CREATE INDEX i ON t(p_brand); DROP INDEX i ON t; ALTER TABLE t DROP COLUMN p_brand",
        "SELECT * FROM t",
        "SELECT p_partkey, p_size FROM part",
    ),
    "index_lookup": (
        "CREATE INDEX by_brand ON t(p_brand)",
        "SELECT p_partkey FROM t WHERE p_brand = 'Brand#13'",
        "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'",
    ),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    out = Session(spark)
    for name in TABLES:
        # schemas are read when a table is used, not for all tables of each query
        out.views.lazy(name, f"{sf_dir}/{name}.parquet")
    return out


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(sql)


def changed(statements: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        s.execute(f"CREATE DATABASE d; USE d; {PART}")
        s.load("t", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.col("p_size").cast("int")))
        failed = [r.messages for r in s.execute(statements) if r.is_error]
        if failed:
            raise RuntimeError(str(failed))
        return s.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: query(v if isinstance(v, str) else v[0]) for k, v in QUERIES.items()}
    return out | {k: changed(v[0], v[1]) for k, v in CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in QUERIES.items()} | {k: v[2] for k, v in CHANGES.items()}
