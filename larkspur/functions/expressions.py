"""Expressions: a tree, the prefix form that writes it, and its meaning as a Spark column.

The prefix form: ``[name]``, ``int[3]``, ``double[0.5]``, ``bool[true]``, ``string[text]``, and ``op (a, b)`` with + - * /
> < == != || &&, ``um (a)`` and ``! (a)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.types import BOOL, DOUBLE, INT, LONG, STRING, EngineError, Type, TypeMismatch, UnknownColumn, text


class ExpressionError(EngineError):
    pass


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool

    def __str__(self):
        if isinstance(self.value, bool):
            return f"bool[{str(self.value).lower()}]"
        if isinstance(self.value, float):
            return f"double[{self.value:.6f}]"
        return f"{'int' if isinstance(self.value, int) else 'string'}[{self.value}]"


@dataclass(frozen=True)
class Attribute:
    name: str

    def __str__(self):
        return f"[{self.name}]"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr

    def __str__(self):
        return f"{self.op} ({self.left}, {self.right})"


@dataclass(frozen=True)
class Unary:
    """op: ! or um"""

    op: str
    child: Expr

    def __str__(self):
        return f"!({self.child})" if self.op == "!" else f"um ({self.child})"


@dataclass(frozen=True)
class Aggregate:
    """kind: sum or avg; known to SQL only"""

    kind: str
    child: Expr

    def __str__(self):
        return f"{self.kind}({self.child})"


Expr = Literal | Attribute | Binary | Unary | Aggregate
TRUE = Literal(True)
_HEAD = re.compile(r"\s*(!=|!|\|\||\+|&&|==|>|<|\*|/|-|um\b|\[|int\b|double\b|bool\b|string\b)")


class _Prefix:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def fail(self, what: str):
        raise ExpressionError(f"{what} at {self.at} in {self.source!r}")

    def expect(self, mark: str) -> None:
        rest = self.source[self.at :]
        if not rest.lstrip().startswith(mark):
            self.fail(f"{mark!r} expected")
        self.at += len(rest) - len(rest.lstrip()) + len(mark)

    def until_bracket(self) -> str:
        end = self.source.find("]", self.at)
        if end < 0:
            self.fail("']' expected")
        inner, self.at = self.source[self.at : end], end + 1
        return inner

    def parse(self) -> Expr:
        head = _HEAD.match(self.source, self.at)
        if not head:
            self.fail("an expression expected")
        self.at, head = head.end(), head[1]
        if head == "[":
            return Attribute(self.until_bracket())
        if head in ("int", "double", "bool", "string"):
            self.expect("[")
            inner = self.until_bracket()
            try:
                return Literal({"int": int, "double": float, "bool": lambda x: x.strip() == "true", "string": str}[head](inner))
            except ValueError:
                self.fail(f"{inner!r} is no {head}")
        self.expect("(")
        left = self.parse()
        if head in ("!", "um"):
            self.expect(")")
            return Unary(head, left)
        self.expect(",")
        right = self.parse()
        self.expect(")")
        return Binary(head, left, right)


def parse_prefix(source: str) -> Expr:
    """The expression at the start of the text; what follows it is ignored."""
    return _Prefix(source).parse()


def as_expr(given: Expr | str) -> Expr:
    return parse_prefix(given) if isinstance(given, str) else given


def attributes(e: Expr) -> set[str]:
    if isinstance(e, Attribute):
        return {e.name}
    if isinstance(e, Binary):
        return attributes(e.left) | attributes(e.right)
    return attributes(e.child) if isinstance(e, (Unary, Aggregate)) else set()


def _literal(v) -> tuple[Column, Type]:
    if isinstance(v, bool):
        return F.lit(v), BOOL
    if isinstance(v, int):
        wide = not -(1 << 31) <= v < 1 << 31
        return F.lit(v).cast("bigint" if wide else "int"), LONG if wide else INT
    return (F.lit(v), DOUBLE) if isinstance(v, float) else (F.lit(v), STRING)


def _divide(a: Column, b: Column) -> Column:
    """IEEE division under any setting: by zero it gives an infinity, or NaN for 0 / 0 (a zero's own sign isn't seen)."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), None).when((a == 0) | F.isnan(a), nan).otherwise(F.signum(a) * inf)


def _arithmetic(op: str, a: Column, s: Type, b: Column, t: Type) -> tuple[Column, Type]:
    if s.to_int and t.to_int:
        kind = LONG if s.wide or t.wide else INT
        if op == "/":
            quotient = F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(kind.spark)
            return F.when(b == 0, F.raise_error(F.lit("integer division by zero")).cast(kind.spark)).otherwise(quotient), kind
        return {"+": a + b, "-": a - b, "*": a * b}[op], kind
    a, b = a.cast("double"), b.cast("double")
    return (_divide(a, b) if op == "/" else {"+": a + b, "-": a - b, "*": a * b}[op]), DOUBLE


def compile_expr(e: Expr | str, types: dict[str, Type | None]) -> tuple[Column, Type]:
    """The column an expression stands for, over columns of these types, and its type."""
    e = as_expr(e)
    if isinstance(e, Literal):
        return _literal(e.value)
    if isinstance(e, Attribute):
        if e.name not in types:  # names are case-sensitive
            raise UnknownColumn(f"no column {e.name!r} among {sorted(types)}")
        if types[e.name] is None:
            raise TypeMismatch(f"column {e.name!r} has a type expressions don't know")
        column = F.col("`" + e.name.replace("`", "``") + "`")
        return (column.cast("double") if types[e.name] == DOUBLE else column), types[e.name]
    if isinstance(e, Aggregate):
        raise ExpressionError(f"{e} stands where no aggregate can")
    if isinstance(e, Unary):
        a, s = compile_expr(e.child, types)
        if e.op == "!" and s == BOOL:
            return ~a, BOOL
        if e.op == "um" and s.to_double:
            return -a, s
        raise TypeMismatch(f"{e.op} can't take {s.name}")
    (a, s), (b, t) = compile_expr(e.left, types), compile_expr(e.right, types)
    numbers = s.to_double and t.to_double
    if e.op in ("||", "&&"):
        if s != BOOL or t != BOOL:
            raise TypeMismatch(f"{e.op} can't take {s.name} and {t.name}")
        return (a | b if e.op == "||" else a & b), BOOL
    if e.op in "+-*/":
        if numbers:
            return _arithmetic(e.op, a, s, b, t)
        if e.op == "+":
            return F.concat(text(a, s), text(b, t)), STRING
        raise TypeMismatch(f"{e.op} can't take {s.name} and {t.name}")
    if numbers:
        if not (s.to_int and t.to_int):
            a, b = a.cast("double"), b.cast("double")
    elif not (s == t == BOOL and e.op in ("==", "!=")):
        a, b = text(a, s), text(b, t)
    return {">": a > b, "<": a < b, "==": a == b, "!=": a != b}[e.op], BOOL


def predicate(e: Expr | str, types: dict[str, Type | None]) -> Column:
    column, kind = compile_expr(e, types)
    if kind != BOOL:
        raise TypeMismatch(f"a predicate is a bool, {e} is a {kind.name}")
    return column


def hashed(e: Expr | str, types: dict[str, Type | None]) -> Column:
    """A 64-bit hash of an expression's value; equal values of one type have equal hashes."""
    return F.xxhash64(compile_expr(e, types)[0])
