import pytest

from larkspur.functions.expressions import ExpressionError
from larkspur.functions.types import EngineError, TypeMismatch, UnknownColumn
from larkspur.plans.parser import CreateTable, SqlParseError, parse
from larkspur.session import Session

C = "t.x = 1"


def where(s):
    return parse(f"SELECT t.x FROM t AS t WHERE {s}")


def value(s):
    return str(parse(f"SELECT {s} FROM t AS t").values[0])


@pytest.mark.parametrize("s", [f"{C} OR {C} AND {C}", f"({C} OR {C}) AND {C}", f"NOT NOT {C}", f"(NOT {C})", "t.x < > 1", "(t.x + 1) > 1", "((t.x + 1) > 1)", f"{C} AND ({C})"])
def test_accepted_clauses(s):
    where(s)


@pytest.mark.parametrize("s", [f"({C}) OR {C}", f"({C} AND {C})", f"NOT ({C})", f"(({C}))", "t.x <= 1", "t.x >= 1", "t.x != 1", "t.x", f"{C} AND", "x = 1"])
def test_rejected_clauses(s):
    with pytest.raises(SqlParseError):
        where(s)


@pytest.mark.parametrize("s", ["1 + SUM(t.x)", "(SUM(t.x)) + 1", "SUM(SUM(t.x))", "t.a - 5", "t.a-5", "-5", "5", "1.5e3", ".5", "t.a * (t.b + 1)"])
def test_accepted_values(s):
    value(s)


@pytest.mark.parametrize("s", ["t.a -5", "5-3", "- 5", "SUM(t.x) + 1", "1 * SUM(t.x)", "*", "t.a AS b", "COUNT(t.x)", "t.a; t.b", "t.a $ 1"])
def test_rejected_values(s):
    with pytest.raises(SqlParseError):
        value(s)


def test_trees():
    assert value("t.a - t.b - t.c") == "- ([t_a], - ([t_b], [t_c]))"
    assert value("t.a / t.b * t.c + 1") == "+ (/ ([t_a], * ([t_b], [t_c])), int[1])"
    assert value("t.a-5") == "[t_a-5]" and value("-5") == "double[-5.000000]" and value("5") == "int[5]"
    assert value('"a \\" b"') == 'string[a \\" b]'
    assert value("1 + SUM(t.x * 2)") == "+ (int[1], sum(* ([t_x], int[2])))"
    q = where(f"{C} OR t.y > 2 AND NOT t.z < > 3")
    assert [str(d) for d in q.where] == ["|| (== ([t_x], int[1]), > ([t_y], int[2]))", "!(!= ([t_z], int[3]))"]
    assert [str(d) for d in parse("SELECT t.a FROM t AS t").where] == ["bool[true]"]
    assert parse("SELECT t.a FROM u AS t, v AS w WHERE t.a = 1 GROUP BY t.a").tables == (("u", "t"), ("v", "w"))


def test_keywords_in_any_case_and_faults_with_their_line():
    q = parse("create Table t (a INT, b double, c String, d bool) as bplustree on b;")
    assert isinstance(q, CreateTable) and q.order_by == "b" and [k.name for _, k in q.columns] == ["int", "double", "string", "bool"]
    with pytest.raises(SqlParseError) as e:
        parse("SELECT t.a\nFROM t AS t\nWHERE t.a ==")
    assert e.value.line == 3
    for bad in ("SELECT t.a FROM t", "SELECT t.a FROM t AS t GROUP BY t.a", "CREATE TABLE t ()", "CREATE TABLE t (a FLOAT)", "SELECT FROM t AS t", "DROP TABLE t"):
        with pytest.raises(SqlParseError):
            parse(bad)


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (3, 4.0, "a")], "x int, y double, z string"))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_select(session):
    assert rows(session.sql("SELECT a.x, a.y + 1 FROM t AS a WHERE a.x > 1")) == [(2, 4.0), (3, 5.0)]
    assert session.sql("SELECT a.x, a.x + 1, a.x FROM t AS a").columns == ["a_x", "expr_2", "expr_3"]
    out = session.sql("SELECT (SUM(a.x)) + 1, a.z, AVG(a.y) FROM t AS a WHERE a.x > 0 GROUP BY a.z")
    assert out.columns == ["expr_1", "a_z", "expr_3"] and rows(out) == [(3, "b", 3.0), (5, "a", 3.0)]
    assert rows(session.sql("SELECT a.x + 1 FROM t AS a WHERE a.x > 0 GROUP BY a.x + 1")) == [(2,), (3,), (4,)]
    assert rows(session.sql("SELECT SUM(a.x) FROM t AS a WHERE a.x > 9")) == [(None,)]
    assert rows(session.sql("SELECT a.x, b.x FROM t AS a, t AS b WHERE a.z = b.z AND a.x < b.x")) == [(1, 3)]


def test_equalities_become_joins(session):
    session.spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = session.sql("SELECT a.x FROM t AS a, t AS b, t AS c WHERE a.x = b.x AND b.y = c.y AND a.z = \"a\"")._jdf.queryExecution().executedPlan().toString()
    finally:
        session.spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert shown.count("Join") == 2 and "Cartesian" not in shown and "NestedLoop" not in shown


@pytest.mark.parametrize(
    ("source", "error"),
    [
        ("SELECT a.q FROM t AS a", UnknownColumn), ("SELECT a.X FROM t AS a", UnknownColumn), ("SELECT a.x FROM u AS a", EngineError),
        ("SELECT a.x FROM t AS a, t AS a", EngineError), ("SELECT SUM(SUM(a.x)) FROM t AS a", ExpressionError), ("SELECT SUM(a.z) FROM t AS a", TypeMismatch),
        ("SELECT a.x FROM t AS a WHERE a.x > 1 GROUP BY a.z", UnknownColumn), ("SELECT a.x FROM t AS a WHERE 1 + SUM(a.x) > 1", ExpressionError), ("SELECT a.x - a.z FROM t AS a", TypeMismatch),
    ],
)
def test_faults_are_told_before_a_query_runs(session, source, error):
    with pytest.raises(error):
        session.sql(source)
