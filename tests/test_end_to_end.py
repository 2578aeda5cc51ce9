"""Fixtures with known answers: a two-table join set with small row groups, a set in three files, and a spill set."""

import datetime
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakequill.errors import ExecutionError, IoError, ParseError, PlanError, UnsupportedError
from lakequill.session import Session

START = datetime.date(1995, 1, 1)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    n = range(10_000)
    lineitem = pa.table({
        "l_orderkey": pa.array([i % 1000 for i in n], pa.int64()),
        "l_qty": pa.array([None if i % 13 == 0 else float(i % 50) for i in n]),
        "l_price": [i % 97 + 0.5 for i in n],
        "l_flag": ["ANR"[i % 3] for i in n],
        "l_shipdate": pa.array([START + datetime.timedelta(i % 30) for i in n], pa.date32()),
    })
    orders = pa.table({
        "o_orderkey": pa.array(range(1000), pa.int64()),
        "o_orderdate": pa.array([START + datetime.timedelta(j // 100) for j in range(1000)], pa.date32()),
        "o_orderpriority": [("1-URGENT", "2-HIGH", "3-MEDIUM")[j % 3] for j in range(1000)],
    })
    for name, t, size in (("lineitem", lineitem, 2500), ("orders", orders, 100)):
        (d / name).mkdir()
        pq.write_table(t, d / name / "part-0.parquet", row_group_size=size)
    (d / "sales").mkdir()
    for part in range(3):
        i = range(part * 3000, part * 3000 + 3000)
        pq.write_table(pa.table({"s_region": pa.array([x % 5 for x in i], pa.int64()), "s_amount": [(x % 101) * 0.25 for x in i], "s_kind": ["store" if x % 2 else "online" for x in i]}), d / "sales" / f"part-{part}.parquet")
    pq.write_table(pa.table({"r_id": pa.array(range(5), pa.int64()), "r_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}), d / "region.parquet")
    return str(d)


@pytest.fixture(scope="module")
def session(spark, data):
    return Session(spark, data)


def values(session, sql):
    return [tuple(r) for r in session.run(sql).rows]


def test_counts(session):
    assert values(session, "SELECT count(*), count(l_qty) FROM lineitem") == [(10000, 9230)]


def test_groups(session):
    got = values(session, "SELECT l_flag, sum(l_price), count(*), avg(l_qty), min(l_shipdate) FROM lineitem WHERE l_shipdate < DATE '1995-01-10' GROUP BY l_flag ORDER BY l_flag")
    assert [r[:3] for r in got] == [("A", 48499.0, 1002), ("N", 48434.0, 1002), ("R", 48466.0, 1002)]
    assert [r[3] for r in got] == pytest.approx([23.043243243243244, 23.956756756756757, 25.003243243243244])
    assert [r[4].day for r in got] == [1, 2, 3]


def test_join_and_top(session):
    got = values(session, "SELECT o_orderpriority, sum(l_price) AS revenue FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderdate >= DATE '1995-01-05' GROUP BY o_orderpriority ORDER BY revenue DESC LIMIT 2")
    assert got == [("3-MEDIUM", 96854.0), ("1-URGENT", 96817.0)]


def test_pruning_is_reported(session):
    sql = "SELECT count(*) FROM orders WHERE o_orderdate >= DATE '1995-01-08'"
    assert values(session, sql) == [(300,)]
    shown = session.run(f"EXPLAIN {sql}").text
    assert "row_groups=3/10" in shown and "== Optimized logical plan ==" in shown
    ran = session.run(f"explain analyze {sql}").text
    assert "1 result row(s)" in ran and "rows_out=300" in ran and "== Pipelines ==" in ran and "row_groups=3/10" in ran
    assert re.search(r"HashAggregate.*rows_in=300 rows_out=1", ran) and re.search(r"#0 +[0-9.]+ ms  .*HashAggregate", ran)


def test_analyze_leaves_the_result_where_it_is(session, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", None)
    assert "10000 result row(s)" in session.run("EXPLAIN ANALYZE SELECT l_orderkey FROM lineitem ORDER BY l_price").text


def test_conditions(session):
    sql = """SELECT sum(CASE WHEN l_flag IN ('A', 'R') AND l_price BETWEEN 10 AND 20 THEN 1 ELSE 0 END) AS a,
             sum(CASE WHEN l_flag LIKE 'N%' AND l_price BETWEEN 10 AND 40 THEN 1 ELSE 0 END) AS b FROM lineitem"""
    a = sum((i % 3 != 1) and 10 <= i % 97 + 0.5 <= 20 for i in range(10_000))
    b = sum((i % 3 == 1) and 10 <= i % 97 + 0.5 <= 40 for i in range(10_000))
    assert values(session, sql) == [(a, b)]


def test_three_files(session):
    got = values(session, "SELECT r_name, sum(s_amount), count(*), avg(s_amount), max(s_kind) FROM sales, region WHERE s_region = r_id GROUP BY r_name ORDER BY r_name")
    assert got[0] == ("AFRICA", 22484.25, 1800, 12.49125, "store") and got[4] == ("MIDDLE EAST", 22466.25, 1800, 12.48125, "store")
    assert values(session, "SELECT sum(s_amount), min(s_amount), count(*) FROM sales WHERE s_kind = 'online'") == [(56193.75, 0.0, 4500)]
    assert values(session, "SELECT count(*) AS c FROM sales GROUP BY s_kind HAVING count(*) > 1 ORDER BY c DESC LIMIT 1") == [(4500,)]


def test_parts_of_a_table_add_up_to_the_whole(spark, session):
    sql = "SELECT s_region, sum(s_amount) AS t, count(s_kind) AS n FROM sales GROUP BY s_region"
    parts = [Session(spark, session.catalog.restrict_to_files("sales", [i])).dataframe(sql) for i in range(3)]
    got = {r.s_region: r for r in parts[0].union(parts[1]).union(parts[2]).groupBy("s_region").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()}
    for region, total, n in values(session, sql):
        assert got[region].t == pytest.approx(total, rel=1e-9) and got[region].n == n


def test_large_groups(spark):
    k = [spark.range(50_000).select(((F.col("id") * 7 + b) % 50_000).alias("k"), F.lit(1).cast("long").alias("v")) for b in range(10)]
    whole = k[0]
    for x in k[1:]:
        whole = whole.union(x)
    out = Session(spark, {"t": whole}).dataframe("SELECT k, sum(v) AS n FROM t GROUP BY k")
    assert out.count() == 50_000 and out.filter("n <> 10").isEmpty()


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT DISTINCT l_flag FROM lineitem", UnsupportedError),
        ("SELECT nope FROM lineitem", PlanError),
        ("SELECT 1 FROM nothing", PlanError),
        ("SELEC 1", ParseError),
        ("SELECT l_flag FROM lineitem GROUP BY", ParseError),
        ("SELECT l_flag, count(*) FROM lineitem", PlanError),
        ("SELECT l_flag FROM lineitem, orders", UnsupportedError),
        ("SELECT l_flag FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", UnsupportedError),
        ("SELECT l_flag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)", UnsupportedError),
        ("WITH x AS (SELECT 1) SELECT * FROM x", UnsupportedError),
        ("SELECT l_flag FROM lineitem UNION SELECT l_flag FROM lineitem", UnsupportedError),
        ("SELECT sum(l_price) OVER () FROM lineitem", UnsupportedError),
        ("SELECT count(DISTINCT l_flag) FROM lineitem", UnsupportedError),
        ("SELECT upper(l_flag) FROM lineitem", UnsupportedError),
        ("SELECT l_flag FROM lineitem LIMIT 1 + 1", UnsupportedError),
        ("SELECT l_flag FROM lineitem FETCH FIRST 3 ROWS ONLY", UnsupportedError),
        ("SELECT l_orderkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey", PlanError),
        ("SELECT l_flag FROM lineitem, orders WHERE l_flag = o_orderkey", PlanError),
        ("SELECT l_flag FROM lineitem GROUP BY 2", PlanError),
        ("SELECT l_flag FROM lineitem ORDER BY 2", PlanError),
        ("SELECT sum(sum(l_price)) FROM lineitem", PlanError),
        ("SELECT l_flag FROM lineitem WHERE l_shipdate < DATE '1995-13-01'", PlanError),
        ("SELECT CAST('x' AS DATE) FROM lineitem", ExecutionError),
        ("SELECT CAST(l_flag AS INT) FROM lineitem", UnsupportedError),
        ("SELECT CAST(l_flag AS DATE) FROM lineitem", ExecutionError),
        ("SELECT min(l_price > 1) FROM lineitem", ExecutionError),
        ("SELECT 9223372036854775807 + 1 FROM lineitem", PlanError),
        ("INSERT INTO lineitem VALUES (1)", UnsupportedError),
        ("SELECT l_flag FROM lineitem ORDER BY sum(l_price)", PlanError),
    ],
)
def test_rejected(session, sql, error):
    with pytest.raises(error):
        session.run(sql)


def test_unknown_table_names_the_known(session):
    with pytest.raises(PlanError, match="lineitem, orders, region, sales"):
        session.run("SELECT 1 FROM nothing")


def test_catalog_errors(spark, tmp_path):
    with pytest.raises(IoError):
        Session(spark, str(tmp_path / "none"))
    (tmp_path / "t").mkdir()
    pq.write_table(pa.table({"a": pa.array([1], pa.int64())}), tmp_path / "t" / "1.parquet")
    pq.write_table(pa.table({"a": pa.array(["x"])}), tmp_path / "t" / "2.parquet")
    with pytest.raises(PlanError, match="differ in their schemas"):
        Session(spark, str(tmp_path))


@pytest.mark.parametrize("how", ["few", "many", "hadoop"])
def test_schemas_are_compared_alike_at_every_size(spark, tmp_path, monkeypatch, how):
    """A file that lacks a column, or has it in another place, is found whether footers are read here, in tasks, or by Hadoop."""
    from lakequill.sources import catalog

    monkeypatch.setattr(catalog, "MOST_FOOTERS", 100 if how == "few" else 1)
    if how == "hadoop":
        monkeypatch.setattr(catalog, "SCHEMES", {})
    both = {"a": pa.array([1], pa.int64()), "b": pa.array(["x"])}
    for name, second in (("lacks", {"a": both["a"]}), ("more", both | {"c": both["a"]}), ("turned", {"b": both["b"], "a": both["a"]}), ("same", both)):
        (tmp_path / name / "t").mkdir(parents=True)
        for i in range(4):
            pq.write_table(pa.table(second if i == 2 else both), tmp_path / name / "t" / f"{i}.parquet")
        if name == "same":
            assert Session(spark, str(tmp_path / name)).run("SELECT count(b) FROM t").rows[0][0] == 4
        else:
            with pytest.raises(PlanError, match="differ in their schemas"):
                Session(spark, str(tmp_path / name))


def test_memory_errors_are_named():
    from lakequill.errors import ResourcesExhausted, from_spark

    e = from_spark(RuntimeError("[UNABLE_TO_ACQUIRE_MEMORY] Unable to acquire 65536 bytes of memory, got 12."))
    assert isinstance(e, ResourcesExhausted) and e.requested == 65536
    assert isinstance(from_spark(RuntimeError("java.lang.OutOfMemoryError: Java heap space")), ResourcesExhausted)


def test_joins_in_any_order_give_the_same(spark, session):
    """More than two relations are joined by size; columns under * stay in the order of FROM."""
    sql = "SELECT * FROM sales, region, lineitem, orders WHERE s_region = r_id AND l_orderkey = o_orderkey AND o_orderkey = s_region AND l_qty > 40"
    got = session.run(sql)
    assert got.columns[:5] == ["s_region", "s_amount", "s_kind", "r_id", "r_name"] and got.columns[5] == "o_orderkey" and got.columns[-1] == "l_shipdate"
    assert len(got.rows) == sum(1800 * n for n in [sum(1 for i in range(10_000) if i % 1000 == k and i % 13 and i % 50 > 40) for k in range(5)])
    # a condition with two relations on one side
    assert values(session, "SELECT count(*) FROM orders a, orders b, orders c WHERE a.o_orderkey = b.o_orderkey AND a.o_orderkey + b.o_orderkey = c.o_orderkey") == [(500,)]


def test_decimals_are_doubles_and_names_ignore_case(spark, tmp_path):
    import decimal

    pq.write_table(pa.table({"Price": pa.array([decimal.Decimal("1.25"), None], pa.decimal128(10, 2)), "n": pa.array([1, 2], pa.int16())}), tmp_path / "Goods.parquet")
    s = Session(spark, str(tmp_path))
    assert s.catalog.table_names() == ["goods"] and s.catalog.table("GOODS").columns == {"Price": "double", "n": "int"}
    assert values(s, "SELECT PRICE * 2, n FROM goods g WHERE G.price IS NOT NULL") == [(2.5, 1)]
