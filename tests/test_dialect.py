"""The dialect's own rules: names, constants, nulls, wrapping, division, dates."""

import datetime
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakequill.__main__ import main, repl
from lakequill.config import ExecConfig, parse_bytes
from lakequill.display import cell, format_csv, format_table
from lakequill.errors import ParseError, PlanError, ResourcesExhausted, UnsupportedError
from lakequill.plans import binder, parser
from lakequill.plans.explain import format_bytes
from lakequill.session import Session, split_explain


@pytest.fixture(scope="module")
def session(spark):
    t = spark.createDataFrame(
        [(1, 10, 2.5, "ab", datetime.date(2024, 1, 31), True), (2, None, None, "a_b", None, None), (2147483647, 0, 0.0, "a\\b", datetime.date(2023, 2, 28), False)],
        "i int, l long, d double, s string, t date, b boolean",
    )
    return Session(spark, {"t": t, "u": spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")})


def one(session, expression, where="i = 1"):
    return session.run(f"SELECT {expression} AS v FROM t WHERE {where}").rows[0]["v"]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("1 / 0", None), ("l / 0", None), ("l % 0", None), ("7 % 3", 1), ("-7 % 3", -1), ("l / 4", 2.5), ("0.06 + 0.01", 0.07), ("1e3", 1000.0),
        ("l * 9223372036854775807", -10), ("- l", -10), ("+l", 10), ("CAST(2.7 AS INT)", 2), ("CAST(-2.7 AS BIGINT)", -2), ("CAST(b AS INT)", 1),
        ("CAST(t AS INT)", 19753), ("CAST(i AS DATE)", datetime.date(1970, 1, 2)), ("t + 1", datetime.date(2024, 2, 1)), ("t - INTERVAL '1' WEEK", datetime.date(2024, 1, 24)),
        ("t + INTERVAL '1' MONTH", datetime.date(2024, 2, 29)), ("t - DATE '2024-01-01'", 30), ("DATE '2024-03-31' - INTERVAL '1' MONTH", datetime.date(2024, 2, 29)),
        ("DATE '2024-02-29' + INTERVAL 1 YEAR", datetime.date(2025, 2, 28)), ("DATE '2024-01-10' - DATE '2024-01-01'", 9), ("NULL", None), ("3 NOT IN (1, NULL)", None), ("1 IN (1, NULL)", True),
        ("CASE i WHEN 1 THEN 1 ELSE 2.5 END", 1.0), ("CASE WHEN b THEN NULL ELSE 5 END", None), ("TRUE AND NULL", None), ("FALSE AND NULL", False), ("TRUE OR NULL", True), ("NOT NULL", None),
        ("s LIKE 'a_'", True), ("'it''s'", "it's"), ("d + 1 > 3 AND i < 1.5", True), ("t >= '2024-01-31'", True), ("CAST(1.0 AS VARCHAR)", "1.0"),
    ],
)
def test_expression(session, expression, value):
    got = one(session, expression)
    assert got == pytest.approx(value) if isinstance(value, float) else got == value


def test_double_modulo_zero_is_nan(session):
    assert math.isnan(one(session, "d % 0.0"))
    assert one(session, "d % 0.0", "i = 2") is None


def test_like_has_no_escape(session):
    assert [r["i"] for r in session.run(r"SELECT i FROM t WHERE s LIKE 'a\b'").rows] == [2147483647]
    assert sorted(r["i"] for r in session.run("SELECT i FROM t WHERE s LIKE 'a_b'").rows) == [2, 2147483647]


def test_fractional_bounds_lose_nothing(session):
    assert sorted(r["i"] for r in session.run("SELECT i FROM t WHERE i < 2.5 AND i > -2.5").rows) == [1, 2]


def test_nulls_come_last_either_way(session):
    assert [r["l"] for r in session.run("SELECT l FROM t ORDER BY l").rows] == [0, 10, None]
    assert [r["l"] for r in session.run("SELECT l FROM t ORDER BY l DESC").rows] == [10, 0, None]
    assert [r["l"] for r in session.run("SELECT l FROM t ORDER BY l DESC NULLS FIRST").rows] == [None, 10, 0]


def test_null_keys_do_not_join(session):
    assert session.run("SELECT v FROM t, u WHERE l = k").rows == [] and session.run("SELECT v FROM t, u WHERE i = k").num_rows == 1


def test_names(session):
    q = session.bind("SELECT sum(d * (1 - i)), count(*), count(*), l, l AS Again, CASE WHEN b THEN 1 END, CAST(i AS DOUBLE) FROM t GROUP BY l, b, i")
    assert q.columns == ["sum(d * 1 - i)", "count(*)", "count(*)_1", "l", "again", "CASE WHEN b THEN 1 END", "CAST(i AS DOUBLE)"]
    assert session.bind("SELECT * FROM u, t WHERE k = i").columns == ["k", "v", "i", "l", "d", "s", "t", "b"]


def test_alias_wins_in_group_by(session):
    got = session.run("SELECT l % 2 AS i, count(*) AS n FROM t GROUP BY i ORDER BY i").rows
    assert [(r["i"], r["n"]) for r in got] == [(0, 2), (None, 1)]


def test_empty_and_null_aggregates(session):
    got = session.run("SELECT count(*) AS a, sum(d) AS b, max(s) AS c FROM t WHERE i < 0").rows
    assert [tuple(r) for r in got] == [(0, None, None)]
    assert session.run("SELECT s, count(*) FROM t WHERE i < 0 GROUP BY s").num_rows == 0
    assert tuple(session.run("SELECT sum(b) AS x, avg(b) AS y, avg(i) AS z FROM t WHERE i < 3").rows[0]) == (1, 1.0, 1.5)


def test_sums_wrap(session):
    assert session.run("SELECT sum(l * 922337203685477580) AS x FROM t").rows[0]["x"] == 9223372036854775800
    assert session.run("SELECT sum(i) AS x FROM t").rows[0]["x"] == 2147483650


def test_parser():
    assert split_explain("  explain  ANALYZE select 1")[0] == "analyze" and split_explain("EXPLAIN x") == ("explain", " x") and split_explain("select 1")[0] == "query"
    s = parser.parse('SELECT "A" x, b /* c */ FROM db.t AS q -- end\n WHERE a = 1 LIMIT 5, 3;')
    assert (s.offset, s.limit, s.relations[0].table, s.relations[0].alias) == (5, 3, "t", "q") and s.items[0] == (parser.Column(None, "a"), "x")
    for bad in ("SELECT 'open FROM t", "SELECT a FROM t WHERE", "SELECT a b c FROM t", "SELECT CASE END FROM t", "SELECT (a FROM t", "SELECT a FROM t WHERE a ? 1"):
        with pytest.raises(ParseError):
            parser.parse(bad)
    for other in ("SELECT a || b FROM t", "SELECT a ILIKE 'x' FROM t", "SELECT t.* FROM t", "SELECT 1", "SELECT TRY_CAST(a AS INT) FROM t", "SELECT CAST(a AS BLOB) FROM t", "(SELECT a FROM t) ORDER BY a"):
        with pytest.raises(UnsupportedError):
            parser.parse(other)


@given(st.dates(datetime.date(1700, 1, 1), datetime.date(2400, 1, 1)), st.integers(-2000, 2000))
def test_months_clamp_to_their_end(d, n):
    got = binder.add_months(d, n)
    assert (got.year * 12 + got.month) - (d.year * 12 + d.month) == n
    assert got.day == d.day or got.day < d.day and (got + datetime.timedelta(1)).day == 1


@pytest.mark.parametrize(("text", "size"), [("512MB", 512 << 20), ("2GB", 2 << 30), ("100kb", 100 << 10), ("1.5g", 3 << 29), ("7", 7), ("3 GiB", 3 << 30), ("9B", 9)])
def test_sizes(text, size):
    assert parse_bytes(text) == size


def test_bad_size_and_errors():
    with pytest.raises(PlanError):
        parse_bytes("12 parsecs")
    assert str(PlanError("x")) == "planning error: x"
    e = ResourcesExhausted("HashAggregate", 10, 90, 95)
    assert str(e) == "memory limit exceeded: operator 'HashAggregate' requested 10 bytes but 90 of 95 bytes are already reserved"
    assert ExecConfig(batch_size=100).session_confs()["spark.sql.parquet.columnarReaderBatchSize"] == "100"
    assert format_bytes(10) == "10B" and format_bytes(1536) == "1.5KiB"


def test_text_output():
    assert [cell(x) for x in (None, True, 1.0, 1e21, 0.1, float("nan"), 5, "x")] == ["NULL", "true", "1", "1000000000000000000000", "0.1", "NaN", "5", "x"]
    assert format_csv([(1, None, 'a"b', "c,d")]) == '1,NULL,"a""b","c,d"\n'
    assert format_table(["a", "long"], [(1, "x")]).splitlines() == ["+---+------+", "| a | long |", "+---+------+", "| 1 | x    |", "+---+------+", "1 row(s)"]


def test_command_line(spark, capsys, tmp_path):
    spark.range(3).selectExpr("id AS a").write.parquet(str(tmp_path / "t"))
    assert main(["query", "SELECT a FROM t ORDER BY a DESC;", "--data", str(tmp_path), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "2\n1\n0\n"
    assert main(["bench", "SELECT count(*) FROM t", "--data", str(tmp_path), "--runs", "2", "--json"]) == 0
    assert '"rows": 1' in capsys.readouterr().out
    assert main(["query", "SELECT b FROM t", "--data", str(tmp_path)]) == 1 and "planning error" in capsys.readouterr().err
    assert main(["worker"]) == 1
    repl(Session(spark, str(tmp_path)), ["SELECT a\n", "FROM t WHERE a = 1; SELECT nope FROM t;\n"])
    assert "1 row(s)" in (out := capsys.readouterr().out) and "error: planning error" in out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 49)), st.integers(-1000, 999)), max_size=200), st.integers(1, 7))
def test_aggregate_equals_a_dictionary(spark, rows, parts):
    df = spark.createDataFrame(rows, "k long, v long").repartition(parts)
    got = {r["k"]: (r["s"], r["n"], r["m"]) for r in Session(spark, {"t": df}).run("SELECT k, sum(v) AS s, count(*) AS n, min(v) AS m FROM t GROUP BY k").rows}
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert got == {k: (sum(v), len(v), min(v)) for k, v in want.items()}
