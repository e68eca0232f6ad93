"""A parsed SELECT as one DataFrame.

Tables are joined by one cross join under a filter of all clauses: Catalyst makes hash or merge joins of the equalities
among them, pushes what concerns one table to its scan, and chooses the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.expressions import TRUE, Aggregate, Attribute, Binary, Expr, ExpressionError, Unary, compile_expr, predicate
from larkspur.functions.types import EngineError, types_of
from larkspur.operators.relational import aggregate_columns
from larkspur.plans.parser import Select


def _aggregates(e: Expr, inside: bool = False) -> list[Aggregate]:
    if isinstance(e, Aggregate):
        if inside:
            raise ExpressionError(f"{e} stands within an aggregate")
        _aggregates(e.child, True)
        return [e]
    if isinstance(e, Binary):
        return _aggregates(e.left, inside) + _aggregates(e.right, inside)
    return _aggregates(e.child, inside) if isinstance(e, Unary) else []


def _replaced(e: Expr, by: dict[Expr, Attribute]) -> Expr:
    if e in by:
        return by[e]
    if isinstance(e, Binary):
        return Binary(e.op, _replaced(e.left, by), _replaced(e.right, by))
    return Unary(e.op, _replaced(e.child, by)) if isinstance(e, Unary) else e


def output_names(values: Sequence[Expr]) -> list[str]:
    """An attribute by its name, others expr_N by place; what would occur twice is expr_N too."""
    names = [v.name if isinstance(v, Attribute) else f"expr_{k}" for k, v in enumerate(values, 1)]
    return [f"expr_{k}" if names.index(n) < k - 1 else n for k, n in enumerate(names, 1)]


def plan(query: Select, table: Callable[[str], DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """The DataFrame of a query; table: gives a table by name; names: of the output columns."""
    names = list(names) if names is not None else output_names(query.values)
    if len(names) != len(query.values):
        raise EngineError(f"{len(names)} names for {len(query.values)} columns")
    df, aliases = None, set()
    for name, alias in query.tables:
        if alias in aliases:
            raise EngineError(f"alias {alias!r} occurs twice")
        aliases.add(alias)
        one = table(name)
        one = one.select(*[F.col(f"`{c}`").alias(f"{alias}_{c}") for c in one.columns])
        df = one if df is None else df.crossJoin(one)
    types = types_of(df)
    for clause in query.where:
        if _aggregates(clause):
            raise ExpressionError("WHERE can't hold an aggregate")
        if clause != TRUE:
            df = df.filter(predicate(clause, types))
    used = list(dict.fromkeys(a for v in query.values for a in _aggregates(v)))
    if not used and not query.groupings:
        return df.select(*[compile_expr(v, types)[0].alias(n) for v, n in zip(query.values, names, strict=True)])
    by, known, groups, made = {}, {}, [], []
    for k, g in enumerate(query.groupings):
        if _aggregates(g):
            raise ExpressionError("GROUP BY can't hold an aggregate")
        column, kind = compile_expr(g, types)
        by[g], known[f"g{k}"] = Attribute(f"g{k}"), kind
        groups.append(column.alias(f"g{k}"))
    for k, a in enumerate(used):
        column, kind = aggregate_columns(a.kind, *compile_expr(a.child, types))
        by[a], known[f"a{k}"] = Attribute(f"a{k}"), kind
        made.append(column.alias(f"a{k}"))
    # Without aggregates the groups themselves are asked for.
    out = df.groupBy(*groups).agg(*made) if made else df.select(*groups).distinct()
    return out.select(*[compile_expr(_replaced(v, by), known)[0].alias(n) for v, n in zip(query.values, names, strict=True)])
