"""The type lattice against plain Python, for all pairs of types and every operator."""

import math

import pytest

from larkspur.functions.expressions import ExpressionError, compile_expr, parse_prefix
from larkspur.functions.types import BOOL, DOUBLE, INT, LONG, STRING, TypeMismatch, UnknownColumn, coerce, types_of

VALUES = {"i": 7, "j": -3, "x": 2.5, "y": -0.0, "s": "12", "e": "", "b": True, "c": False}


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([tuple(VALUES.values())], "i int, j int, x double, y double, s string, e string, b boolean, c boolean").cache()


def text(v):
    return str(v).lower() if isinstance(v, bool) else f"{v:.6f}" if isinstance(v, float) else str(v)


def expected(op, a, b):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    bools = isinstance(a, bool) and isinstance(b, bool)
    if op in ("||", "&&"):
        return (a or b if op == "||" else a and b) if bools else TypeMismatch
    if op in "+-*/":
        if number(a) and number(b):
            if op != "/":
                return {"+": a + b, "-": a - b, "*": a * b}[op]
            if isinstance(a, int) and isinstance(b, int):
                return math.trunc(a / b)
            return a / b if b else math.nan if not a else math.copysign(math.inf, a)
        return text(a) + text(b) if op == "+" else TypeMismatch
    if not (number(a) and number(b)) and not (bools and op in ("==", "!=")):
        a, b = text(a), text(b)
    return {">": a > b, "<": a < b, "==": a == b, "!=": a != b}[op]


@pytest.mark.parametrize("op", ["+", "-", "*", "/", ">", "<", "==", "!=", "||", "&&"])
def test_binary_operators_on_all_pairs(row, op):
    columns, want = [], []
    for a, u in VALUES.items():
        for b, v in VALUES.items():
            e, result = f"{op} ([{a}], [{b}])", expected(op, u, v)
            if result is TypeMismatch:
                with pytest.raises(TypeMismatch):
                    compile_expr(e, types_of(row))
            else:
                columns.append(compile_expr(e, types_of(row))[0].alias(f"c{len(columns)}"))
                want.append(result)
    got = list(row.select(*columns).first())
    for g, w in zip(got, want, strict=True):
        assert type(g) is type(w) and (g == w or (isinstance(w, float) and math.isnan(g) and math.isnan(w)))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_division_under_either_setting(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(1.0, 0.0, -7, 2), (-1.0, 0.0, 7, -2), (0.0, 0.0, 0, 5)], "a double, b double, n int, m int")
        q, kind = compile_expr("/ ([a], [b])", types_of(df))
        r, whole = compile_expr("/ ([n], [m])", types_of(df))
        assert (kind, whole) == (DOUBLE, INT)
        got = [tuple(x) for x in df.select(q, r).collect()]
        assert got[:2] == [(math.inf, -3), (-math.inf, -3)] and math.isnan(got[2][0]) and got[2][1] == 0
        with pytest.raises(Exception, match="division by zero"):
            df.select(compile_expr("/ ([n], - ([m], [m]))", types_of(df))[0]).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_literals_unary_and_printing(row):
    for source, value in (("int[5]", 5), ("double[0.5]", 0.5), ("bool[true]", True), ("bool[yes]", False), ("string[a b|c]", "a b|c"), ("um ([x])", -2.5), ("! ([b])", False), ("um (um ([i]))", 7)):
        assert row.select(compile_expr(source, types_of(row))[0]).first()[0] == value
    source = "&& (> (+ ([i], int[1]), double[0.500000]), !(== ([s], string[q])))"
    assert str(parse_prefix(source)) == source
    assert str(parse_prefix(source + ") trailing")) == source


@pytest.mark.parametrize("bad", ["", "foo", "+ ([i])", "+ ([i], )", "[i", "int[x]", "integer[3]", "? ([i], [j])"])
def test_bad_prefix_text(bad):
    with pytest.raises(ExpressionError):
        parse_prefix(bad)


def test_names_are_case_sensitive(row):
    with pytest.raises(UnknownColumn):
        compile_expr("[I]", types_of(row))


def test_wide_ints(spark):
    df = spark.range(1).withColumnRenamed("id", "k")
    assert compile_expr("+ ([k], int[1])", types_of(df))[1] == LONG
    assert compile_expr("/ ([k], int[2])", types_of(df))[1] == LONG
    assert df.select(compile_expr("+ ([k], int[3000000000])", types_of(df))[0]).first()[0] == 3_000_000_000


def test_coercions(row):
    from pyspark.sql import functions as F

    kinds = {"i": INT, "x": DOUBLE, "s": STRING, "b": BOOL}
    allowed = {("i", "int"): 7, ("i", "double"): 7.0, ("i", "string"): "7", ("x", "int"): 2, ("x", "double"): 2.5, ("x", "string"): "2.500000", ("s", "string"): "12", ("b", "string"): "true", ("b", "bool"): True}
    for c, have in kinds.items():
        for want in (INT, DOUBLE, STRING, BOOL):
            if (c, want.name) in allowed:
                assert row.select(coerce(F.col(c), have, want)).first()[0] == allowed[c, want.name]
            else:
                with pytest.raises(TypeMismatch):
                    coerce(F.col(c), have, want)


def test_outside_types_are_carried_but_not_computed_with(spark):
    from larkspur.operators import selection

    df = spark.sql("SELECT 1 AS a, timestamp'2020-01-01 00:00:00' AS t")
    assert selection(df, "== ([a], int[1])").columns == ["a", "t"]
    with pytest.raises(TypeMismatch):
        selection(df, "== ([t], int[1])")
