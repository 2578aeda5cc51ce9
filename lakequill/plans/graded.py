"""Registered queries over the dialect's operators: each is a statement of the dialect, with the SQL that an oracle runs.

Where a statement means the same to both, one text serves. Where they differ (integer division of types, HUGEINT sums,
rounding casts, intervals that turn dates into timestamps, literal escapes), the oracle's text pins the dialect's meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..session import Session

#: name: (statement of the dialect, oracle's SQL or None for the same)
QUERIES: dict[str, tuple[str, str | None]] = {
    # the reference workload, fitted to the columns at hand
    "tpch_q1": (
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
        sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
        avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        None,
    ),
    "tpch_q3": (
        """SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        None,
    ),
    "tpch_q5": (
        """SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR
        GROUP BY n_name ORDER BY revenue DESC""",
        None,
    ),
    "tpch_q6": (
        """SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR
        AND l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 24""",
        None,
    ),
    "tpch_q10": (
        """SELECT c_custkey, c_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01'
        AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        None,
    ),
    "tpch_q12": (
        """SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
        sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate
        AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR
        GROUP BY l_linestatus ORDER BY l_linestatus""",
        """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate
        AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR
        GROUP BY l_linestatus ORDER BY l_linestatus""",
    ),
    "tpch_q14": (
        """SELECT 100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-09-01' + INTERVAL '1' MONTH""",
        None,
    ),
    # scans and projection
    "scan_project": ("SELECT o_orderkey, o_orderpriority FROM orders", None),
    "select_star_join": ("SELECT * FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey", None),
    "mod_double": ("SELECT l_orderkey, l_linenumber, l_quantity % 7.5 AS m, l_extendedprice % l_quantity AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, fmod(l_quantity, 7.5) AS m, fmod(l_extendedprice, l_quantity) AS r FROM lineitem"),
    "cast_int_wraps": ("SELECT o_orderkey, CAST(o_orderkey * 1000003 * 4099 AS INT) AS w FROM orders", "SELECT o_orderkey, CAST((o_orderkey * 1000003 * 4099 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS w FROM orders"),
    "cast_date_int": ("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS INT) AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d FROM orders"),
    "cast_int_date": ("SELECT c_custkey, CAST(c_nationkey AS DATE) AS d FROM customer", "SELECT c_custkey, CAST(DATE '1970-01-01' + c_nationkey AS DATE) AS d FROM customer"),
    "cast_string_date": ("SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS DATE) AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "case_typing": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size WHEN p_size < 20 THEN p_retailprice WHEN p_size < 30 THEN NULL ELSE p_partkey END AS v FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(p_size AS DOUBLE) WHEN p_size < 20 THEN p_retailprice WHEN p_size < 30 THEN NULL ELSE CAST(p_partkey AS DOUBLE) END AS v FROM part"),
    "select_star": ("SELECT * FROM nation", None),
    "alias_expr": ("SELECT p_partkey AS k, p_size + 1 AS next_size FROM part", "SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS next_size FROM part"),
    "count_star_no_columns": ("SELECT count(*) AS n FROM lineitem", None),
    "auto_named_columns": ("SELECT s_suppkey, s_acctbal * 2, s_suppkey FROM supplier", 'SELECT s_suppkey, s_acctbal * 2 AS "s_acctbal * 2", s_suppkey AS s_suppkey_1 FROM supplier'),
    # predicates
    "cmp_all_ops": ("SELECT p_partkey FROM part WHERE p_size = 10 OR p_size <> 20 AND p_size < 5 OR p_size > 45 AND p_retailprice >= 1000 AND p_retailprice <= 1400", None),
    "cmp_strings": ("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'", None),
    "and_or_not_kleene": (
        "SELECT o_orderkey FROM orders WHERE NOT (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 100000 END AND o_custkey % 2 = 0) OR CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey < 50 END",
        None,
    ),
    "between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", None),
    "not_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48", None),
    "in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", None),
    "not_in_list": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2, 3, 20)", None),
    "in_list_null": ("SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, NULL, 3) OR n_nationkey NOT IN (2, NULL)", None),
    "is_null": ("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_custkey END IS NULL", None),
    "is_not_null": ("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_custkey END IS NOT NULL", None),
    "like_prefix": ("SELECT p_partkey FROM part WHERE p_name LIKE 's%'", None),
    "like_suffix": ("SELECT p_partkey FROM part WHERE p_name LIKE '%ring'", None),
    "like_contains": ("SELECT p_partkey FROM part WHERE p_name LIKE '%l r%'", None),
    "like_general": ("SELECT p_partkey FROM part WHERE p_name LIKE '_m%l%r_ng'", None),
    "like_exact": ("SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO'", None),
    "like_backslash": (r"SELECT n_nationkey FROM nation WHERE n_name LIKE '%\%' OR n_name LIKE 'C%'", None),
    "not_like": ("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring%'", None),
    # expressions
    "arith_int": ("SELECT o_orderkey, o_orderkey * 3 + o_custkey - 7 AS v FROM orders", None),
    "arith_double": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS v FROM lineitem", None),
    "divide": ("SELECT o_orderkey, o_totalprice / o_custkey AS v, o_custkey / 4 AS w FROM orders", "SELECT o_orderkey, o_totalprice / NULLIF(o_custkey, 0) AS v, o_custkey / 4 AS w FROM orders"),
    "div_by_zero_nullif": ("SELECT p_partkey, p_retailprice / (p_size - 10) AS v FROM part", "SELECT p_partkey, p_retailprice / NULLIF(p_size - 10, 0) AS v FROM part"),
    "mod": ("SELECT o_orderkey, o_orderkey % 7 AS a, o_custkey % 5 AS b FROM orders", None),
    "mod_by_zero": ("SELECT p_partkey, p_partkey % (p_size - 10) AS v FROM part", "SELECT p_partkey, p_partkey % NULLIF(p_size - 10, 0) AS v FROM part"),
    "negate": ("SELECT s_suppkey, -s_acctbal AS v, -s_suppkey AS w FROM supplier", None),
    "case_searched": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS s FROM orders"),
    "case_no_else": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice END AS v FROM part", None),
    "cast_numeric": (
        "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_retailprice AS BIGINT) AS l, CAST(p_size AS DOUBLE) AS d, p_size::BIGINT AS b FROM part",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(trunc(p_retailprice) AS BIGINT) AS l, CAST(p_size AS DOUBLE) AS d, p_size::BIGINT AS b FROM part",
    ),
    "cast_to_string": ("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey % 2 = 0 AS VARCHAR) AS t FROM orders", None),
    "cast_boolean": ("SELECT o_orderkey, CAST(o_custkey > 50 AS INTEGER) AS i FROM orders", None),
    "decimal_literal_fold": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.06 + 0.01 AND l_tax <= 0.1 - 0.06", None),
    "decimal_times_int": ("SELECT p_partkey, 1.5 * p_size AS v FROM part", "SELECT p_partkey, CAST(1.5 * p_size AS DOUBLE) AS v FROM part"),
    # dates
    "date_literal_compare": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-06-01' AND o_orderdate < '1997-07-01'", None),
    "date_add_days": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS d FROM orders", None),
    "date_sub_interval_day": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) - INTERVAL '90' DAY AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL '90' DAY AS DATE) AS d FROM orders"),
    "date_interval_week": ("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01' + INTERVAL '6 weeks'", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01' + INTERVAL '42' DAY"),
    "date_interval_month_clamp": ("SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1996-01-31' + INTERVAL '1' MONTH AND o_orderdate <= DATE '1996-05-31' - INTERVAL '1' MONTH", None),
    "date_interval_year": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-02-29' + INTERVAL '1' YEAR AND o_orderdate < DATE '1997-04-01'", None),
    "date_diff": ("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days FROM orders"),
    # aggregation
    "agg_ungrouped": ("SELECT count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_discount) AS d FROM lineitem", None),
    "agg_empty_input": ("SELECT count(*) AS n, sum(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem WHERE l_quantity < 0", None),
    "agg_empty_groups": ("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", None),
    "agg_group_one_key": ("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority", None),
    "agg_group_multi_key": ("SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber", None),
    "agg_group_expr": ("SELECT p_size % 10 AS bucket, avg(p_retailprice) AS price FROM part GROUP BY p_size % 10", "SELECT CAST(p_size % 10 AS BIGINT) AS bucket, avg(p_retailprice) AS price FROM part GROUP BY p_size % 10"),
    "agg_group_position": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", None),
    "agg_group_alias": ("SELECT CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM orders GROUP BY level", None),
    "agg_null_group": ("SELECT CASE WHEN p_size > 25 THEN p_brand END AS brand, count(*) AS n FROM part GROUP BY brand", None),
    "agg_count_nulls": ("SELECT count(*) AS n, count(CASE WHEN p_size > 25 THEN 1 END) AS big, count(ALL p_name) AS named FROM part", None),
    "agg_sum_int": ("SELECT p_brand, sum(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand"),
    "agg_sum_bool": ("SELECT o_orderstatus, sum(o_totalprice > 100000) AS big FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice > 100000 AS BIGINT)) AS BIGINT) AS big FROM orders GROUP BY o_orderstatus"),
    "agg_min_max_types": (
        "SELECT min(p_size) AS a, max(p_size) AS b, min(p_name) AS c, max(p_name) AS d, min(p_retailprice) AS e, max(p_partkey) AS f FROM part",
        None,
    ),
    "agg_min_max_date": ("SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY o_orderpriority", None),
    "agg_avg": ("SELECT c_mktsegment, avg(c_acctbal) AS a, avg(c_custkey) AS k FROM customer GROUP BY c_mktsegment", None),
    "agg_of_expr": ("SELECT l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY l_linestatus", None),
    "expr_of_aggs": ("SELECT l_returnflag, 100 * sum(l_discount) / count(*) AS pct, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag", None),
    "having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000", None),
    "having_without_group": ("SELECT n_name FROM nation HAVING n_nationkey < 5", "SELECT n_name FROM nation WHERE n_nationkey < 5"),
    "group_as_distinct": ("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    # joins
    "join_on": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_cross_connected": ("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey", None),
    "join_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", None),
    "join_expr_key": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey + 0 = n_nationkey * 1", None),
    "join_mixed_type_key": ("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_suppkey", None),
    "join_theta_residual": ("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_null_keys": ("SELECT n_name, r_name FROM nation JOIN region ON CASE WHEN n_nationkey > 10 THEN n_regionkey END = r_regionkey", None),
    "join_duplicates": ("SELECT p.p_partkey, l.l_orderkey, l.l_linenumber FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE p.p_size = 1", None),
    "join_six_way": (
        "SELECT r_name, count(*) AS n FROM lineitem, orders, customer, nation, region, part WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_partkey = p_partkey AND p_size < 10 GROUP BY r_name",
        None,
    ),
    # sort and limit
    "sort_asc_nulls_last": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS s FROM part ORDER BY s, p_partkey", None),
    "sort_desc_nulls_last": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS s FROM part ORDER BY s DESC, p_partkey", None),
    "sort_nulls_first": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS s FROM part ORDER BY s NULLS FIRST, p_partkey", None),
    "sort_by_alias": ("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 50", None),
    "sort_by_position": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY 2, 1 LIMIT 40", None),
    "sort_by_hidden_expr": ("SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 30", None),
    "sort_by_aggregate": ("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25", None),
    "sort_full": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", None),
    "top_n": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    # pruning
    "range_scan_pruned": ("SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 500", None),
    "pruning_fractional_literal": ("SELECT p_partkey FROM part WHERE p_size < 5.5 AND p_size > -5.5", None),
    # the stream table, read as a batch
    "events_scan_aggregate": ("SELECT event_type, count(*) AS n, sum(value) AS v, min(user_id) AS u FROM events WHERE ts >= DATE '2000-01-01' GROUP BY event_type", None),
}


#: Digits to which sums and means of doubles are rounded on both sides, as their last bits depend on the order of addition.
ROUNDED: dict[str, dict[str, int]] = {
    "tpch_q1": {"sum_qty": 2, "sum_base_price": 2, "sum_disc_price": 2, "sum_charge": 2, "avg_qty": 6, "avg_price": 4, "avg_disc": 6},
    "tpch_q3": {"revenue": 2},
    "tpch_q5": {"revenue": 2},
    "tpch_q6": {"revenue": 2},
    "tpch_q10": {"revenue": 2},
    "tpch_q14": {"promo_revenue": 6},
    "agg_ungrouped": {"q": 2, "d": 6},
    "agg_group_one_key": {"total": 2},
    "agg_group_expr": {"price": 4},
    "agg_avg": {"a": 4, "k": 4},
    "agg_of_expr": {"net": 2},
    "expr_of_aggs": {"pct": 6},
    "range_scan_pruned": {"s": 2},
    "events_scan_aggregate": {"v": 2},
}


_opened: dict[tuple[str, str], Session] = {}


def opened(spark: SparkSession, sf_dir: str) -> Session:
    """One session for each application and folder; tables are opened when a query first needs them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _opened:
        _opened[key] = Session(spark, sf_dir, tables=[])
    return _opened[key]


def _query(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = opened(spark, sf_dir).dataframe(sql)
        return out.withColumns({c: F.round(c, n) for c, n in ROUNDED.get(name, {}).items()})

    return run


#: Statements that are outside the dialect, and the layer that says so.
REJECTED = {
    "SELECT o_orderstatus, o_custkey, count(*) FROM orders GROUP BY o_orderstatus": "Plan",
    "SELECT o_orderkey + count(*) FROM orders GROUP BY o_custkey": "Plan",
    "SELECT o_orderkey FROM orders LIMIT 1 + 1": "Unsupported",
    "SELECT o_orderkey FROM orders LIMIT o_custkey": "Unsupported",
    "SELECT CASE WHEN o_orderkey > 1 THEN 1 ELSE o_orderstatus END FROM orders": "Plan",
    "SELECT CAST(o_orderstatus AS INT) FROM orders": "Unsupported",
    "SELECT CAST(o_totalprice AS DATE) FROM orders": "Unsupported",
    "SELECT CAST(o_orderstatus AS DATE) FROM orders": "Execution",
    "SELECT o_orderkey FROM orders, customer": "Unsupported",
}


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the statements above fails with."""
    rows = []
    for sql in REJECTED:
        try:
            opened(spark, sf_dir).run(sql)
            rows.append((sql, "none"))
        except EngineError as e:
            rows.append((sql, e.kind))
    return spark.createDataFrame(rows, "statement string, failed string")


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at hand as a table, joined with one that is made of them."""
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (None, "c")], "k long, v string")
    return Session(spark, {"t": t, "u": t}).dataframe("SELECT t.k, t.v, u.v AS w FROM t, u WHERE t.k = u.k")


def _file_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table cut down to some of its files: none of them, and all."""
    catalog = opened(spark, sf_dir).catalog
    every, none = (Session(spark, catalog.restrict_to_files("orders", list(kept))) for kept in (range(len(catalog.table("orders").files)), ()))
    sql = "SELECT count(*) AS n, sum(o_custkey) AS s FROM orders"
    return every.dataframe(sql).unionByName(none.dataframe(sql))


#: Queries that take more than a statement: (function, oracle's SQL).
BEYOND_SQL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rejected_statements": (_rejected, "SELECT * FROM (VALUES " + ", ".join(f"('{sql}', '{kind}')" for sql, kind in REJECTED.items()) + ") AS t(statement, failed)"),
    "in_memory_rows": (_in_memory, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 'a'), (2, 'b', 'b'), (2, 'b', NULL), (2, NULL, 'b'), (2, NULL, NULL)) AS t(k, v, w)"),
    "file_subset": (_file_subset, "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders UNION ALL SELECT 0, NULL"),
}


def _oracle(name: str, sql: str) -> str:
    rounded = ", ".join(f"round({c}, {n}) AS {c}" for c, n in ROUNDED.get(name, {}).items())
    return f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS q" if rounded else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, sql) for name, (sql, _) in QUERIES.items()} | {name: f for name, (f, _) in BEYOND_SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _oracle(name, other or sql) for name, (sql, other) in QUERIES.items()} | {name: sql for name, (_, sql) in BEYOND_SQL.items()}
