"""The operators, DataFrame in and DataFrame out. Nothing runs here (but the count of a side that may be broadcast, and of pairs for
``strategy="many"``); Catalyst sees one plan.

Expressions are trees or prefix text. An output schema, where given, fixes names and types; else columns are called
as their attribute, or by their prefix text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from larkspur.functions.expressions import TRUE, Attribute, Expr, as_expr, compile_expr, predicate
from larkspur.functions.types import DOUBLE, INT, LONG, EngineError, Schema, Type, TypeMismatch, coerce, types_of

AGGREGATES = ("cnt", "sum", "avg")


def _named(columns: Sequence[tuple[str, Column, Type]], schema: Schema | None) -> list[Column]:
    if schema is None:
        return [c.alias(n) for n, c, _ in columns]
    if len(schema) != len(columns):
        raise EngineError(f"{len(columns)} columns for a schema of {len(schema)}")
    return [coerce(c, have, want).alias(n) for (_, c, have), (n, want) in zip(columns, schema, strict=True)]


def _project(df: DataFrame, projections: Sequence[Expr | str], schema: Schema | None) -> DataFrame:
    types = types_of(df)
    made = []
    for p in map(as_expr, projections):
        made.append((p.name if isinstance(p, Attribute) else str(p), *compile_expr(p, types)))
    return df.select(*_named(made, schema))


def _filter(df: DataFrame, given: Expr | str) -> DataFrame:
    e = as_expr(given)
    return df if e == TRUE else df.filter(predicate(e, types_of(df)))


def selection(df: DataFrame, where: Expr | str = TRUE, projections: Sequence[Expr | str] | None = None, schema: Schema | None = None) -> DataFrame:
    """Filter and computed projection; without projections all columns."""
    kept = _filter(df, where)
    if projections is None and schema is None:
        return kept
    return _project(kept, [Attribute(c) for c in df.columns] if projections is None else projections, schema)


def range_selection(
    df: DataFrame, key: str, low, high, where: Expr | str = TRUE, projections: Sequence[Expr | str] | None = None, schema: Schema | None = None, *, ordered: bool = False
) -> DataFrame:
    """Rows with low <= key <= high that also pass ``where``; ordered: by ascending key. The bounds reach the scan, and a
    table stored in key order is read only where they fall."""
    types = types_of(df)
    column, kind = compile_expr(Attribute(key), types)
    for bound in (low, high):
        if isinstance(bound, bool) != (kind.name == "bool") or isinstance(bound, str) != (kind.name == "string"):
            raise TypeMismatch(f"{bound!r} is no bound for a key of type {kind.name}")
    raw = F.col(f"`{key}`")  # no cast, so the filter is pushed down
    found = df.filter(raw.between(F.lit(low), F.lit(high)))
    if ordered:
        found = found.orderBy(column.asc())
    return selection(found, where, projections, schema)


_HINTS = {"hash": "shuffle_hash", "merge": "merge", "auto": None, "many": None}


#: Bytes that a side may have, by the plan's statistics, to be broadcast.
BROADCAST_BYTES = 64 << 20

#: Pairs of rows that a task makes where a join is dealt out: at least and at most.
LEAST_PAIRS, MOST_PAIRS = 1 << 20, 1 << 24


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _small(df: DataFrame, most: int) -> bool:
    """By the plan's estimate, which sees wide rows but no filters, and by a count of rows."""
    return _bytes(df) <= BROADCAST_BYTES and df.limit(most + 1).count() <= most


def _dealt(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], condition: Column, max_broadcast_rows: int) -> DataFrame:
    """The join, dealt out by pairs: a key that makes more than a task's share is split among several tasks. Each row of the larger side goes to
    one of them, by its place among the sorted rows of its partition, so that a repeated task deals alike and copies part as well; the smaller side
    is broadcast or, if too large for that, goes to all tasks of its key."""
    names = [f"#k{k}" for k in range(len(keys))]
    pairs = None
    for df, at in ((left, 0), (right, 1)):
        counts = df.groupBy(*[k[at].alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(f"#n{at}"))
        pairs = counts if pairs is None else pairs.join(counts, names)
    made = F.col("#n0") * F.col("#n1")
    many = pairs.groupBy(*[F.when(made > LEAST_PAIRS, F.col(n)).alias(n) for n in names]).agg(F.sum(made).alias("#pairs"))
    found = many.collect()
    heavy, rest = [r for r in found if r[0] is not None], sum(r["#pairs"] for r in found if r[0] is None)  # all keys of few pairs are one row, of null
    total = rest + sum(r["#pairs"] for r in heavy)
    if total <= LEAST_PAIRS:
        return left.join(right, condition, "inner")
    spark = left.sparkSession
    share = min(max(total // (16 * spark.sparkContext.defaultParallelism), LEAST_PAIRS), MOST_PAIRS)
    tasks = light = max(1, -(-rest // share))
    split = []
    for r in heavy:
        split.append((*r[:-1], tasks, -(-r["#pairs"] // share)))
        tasks += split[-1][-1]
    shares = F.broadcast(spark.createDataFrame(split, StructType([*many.schema[:-1]]).add("#first", LongType()).add("#tasks", LongType())))

    at = int(_bytes(left) <= _bytes(right))  # the side that is dealt out
    one, other = (left, right)[at], (left, right)[1 - at]

    def known(df: DataFrame, at: int) -> DataFrame:
        return df.join(shares, [k[at] == F.col(n) for k, n in zip(keys, names, strict=True)], "left")

    place = F.col("#first") + F.pmod("#place", "#tasks")
    one = known(one.sortWithinPartitions(*[k[at] for k in keys], *one.columns).withColumn("#place", F.monotonically_increasing_id()), at)
    if _small(other, max_broadcast_rows):
        task = F.coalesce(place, F.pmod(F.xxhash64(*[k[at] for k in keys]), F.lit(light)))
        one = one.withColumn("#task", task.cast("int")).repartitionById(tasks, F.col("#task"))
        both = other.hint("broadcast").join(one, condition, "inner")
    else:
        one = one.withColumn("#task", F.coalesce(place, F.lit(-1)))
        every = F.when(F.col("#tasks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.col("#first"), F.col("#first") + F.col("#tasks") - 1))
        other = known(other, 1 - at).withColumn("#of", F.explode(every)).drop(*names, "#first", "#tasks")
        both = other.join(one, condition & (F.col("#of") == F.col("#task")), "inner")
    return both.select(*[f"`{c}`" for c in (*left.columns, *right.columns)])


def _join(left, right, keys, where, projections, schema, left_where, right_where, strategy, max_broadcast_rows) -> DataFrame:
    if not keys:
        raise EngineError("a join needs keys")
    twice = set(left.columns) & set(right.columns)
    if twice:
        raise EngineError(f"both sides have columns {sorted(twice)}")
    lt, rt = types_of(left), types_of(right)
    left, right = _filter(left, left_where), _filter(right, right_where)
    condition, columns = None, []
    for a, b in keys:
        a, b = as_expr(a), as_expr(b)
        (x, s), (y, t) = compile_expr(a, lt), compile_expr(b, rt)
        if s.to_double and t.to_double:
            if not (s.to_int and t.to_int):
                x, y = x.cast("double"), y.cast("double")
        elif s.name != t.name:
            raise TypeMismatch(f"keys {a} and {b} are {s.name} and {t.name}")
        condition = x == y if condition is None else condition & (x == y)
        columns.append((x, y))
    if strategy == "broadcast":
        # Only a side of checked size is broadcast; larger ones are hashed in their partitions.
        left = left.hint("broadcast") if _small(left, max_broadcast_rows) else left.hint("shuffle_hash")
    elif _HINTS[strategy]:
        left = left.hint(_HINTS[strategy])
    both = _dealt(left, right, columns, condition, max_broadcast_rows) if strategy == "many" else left.join(right, condition, "inner")
    both = _filter(both, where)
    return both if projections is None and schema is None else _project(both, [Attribute(c) for c in both.columns] if projections is None else projections, schema)


def hash_join(
    left: DataFrame, right: DataFrame, keys: Sequence[tuple[Expr | str, Expr | str]], where: Expr | str = TRUE, projections=None, schema: Schema | None = None, *,
    left_where: Expr | str = TRUE, right_where: Expr | str = TRUE, strategy: str = "auto", max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """Inner equi-join on any number of key pairs (expressions of either side).

    strategy: auto (Spark's choice by size), hash (the left side is the one hashed; a partition of it must fit in memory), broadcast (if the
    left side has at most ``max_broadcast_rows`` rows and ``BROADCAST_BYTES`` bytes, else hash) or many (for keys that repeat on both sides: pairs
    are counted by key, and tasks make about the same number of them).
    """
    if strategy not in ("hash", "broadcast", "auto", "many"):
        raise EngineError(f"no strategy {strategy!r}")
    return _join(left, right, keys, where, projections, schema, left_where, right_where, strategy, max_broadcast_rows)


def sort_merge_join(
    left: DataFrame, right: DataFrame, key: tuple[Expr | str, Expr | str], where: Expr | str = TRUE, projections=None, schema: Schema | None = None, *,
    left_where: Expr | str = TRUE, right_where: Expr | str = TRUE,
) -> DataFrame:
    """Inner equi-join on one key pair by merging; ``where`` holds what else must be true of a pair."""
    return _join(left, right, [key], where, projections, schema, left_where, right_where, "merge", 0)


def aggregate_columns(kind: str, value: Column, have: Type) -> tuple[Column, Type]:
    if kind == "cnt":
        return F.count(F.lit(0)), LONG
    if kind not in AGGREGATES:
        raise EngineError(f"no aggregate {kind!r}")
    if not have.to_double:
        raise TypeMismatch(f"{kind} can't take {have.name}")
    if kind == "avg":
        return F.avg(value.cast("double")), DOUBLE
    return F.sum(value), DOUBLE if have == DOUBLE else LONG


def aggregate(
    df: DataFrame, aggregates: Sequence[tuple[str, Expr | str]], groupings: Sequence[Expr | str] = (), where: Expr | str = TRUE, schema: Schema | None = None
) -> DataFrame:
    """Filter, group by expressions, aggregate (cnt, sum, avg). Groupings come first in the output, then aggregates.

    Without groupings there is one row, also over no rows: a count of 0, other aggregates null.
    """
    kept, types = _filter(df, where), types_of(df)
    groups = []
    for g in map(as_expr, groupings):
        groups.append((g.name if isinstance(g, Attribute) else str(g), *compile_expr(g, types)))
    made = []
    for kind, e in aggregates:
        value, have = compile_expr(e, types) if kind != "cnt" else (F.lit(0), INT)
        made.append((kind if kind == "cnt" else f"{kind}({as_expr(e)})", *aggregate_columns(kind, value, have)))
    inner = [f"g{k}" for k in range(len(groups))] + [f"a{k}" for k in range(len(made))]
    out = kept.groupBy(*[c.alias(n) for (_, c, _), n in zip(groups, inner, strict=False)]).agg(*[c.alias(n) for (_, c, _), n in zip(made, inner[len(groups) :], strict=True)])
    return out.select(*_named([(name, F.col(n), kind) for (name, _, kind), n in zip([*groups, *made], inner, strict=True)], schema))


def sort(df: DataFrame, key: Expr | str, where: Expr | str = TRUE) -> DataFrame:
    """Rows that pass, by ascending key expression."""
    return _filter(df, where).orderBy(compile_expr(key, types_of(df))[0].asc())


def sorted_rows(df: DataFrame, key: Expr | str, where: Expr | str = TRUE) -> Iterator[Row]:
    """As sort(), a row at a time; one partition at a time is held."""
    return sort(df, key, where).toLocalIterator()


def merge_sorted(left: DataFrame, right: DataFrame, key: Expr | str) -> DataFrame:
    """The rows of two tables of one schema in the order of the key."""
    return sort(left.unionByName(right), key)


def union_scan(tables: Sequence[DataFrame], where: Expr | str = TRUE, projections: Sequence[Expr | str] | None = None, schema: Schema | None = None) -> DataFrame:
    """Selection over the rows of several tables of one schema; filters and columns reach each scan."""
    if not tables:
        raise EngineError("a scan needs tables")
    whole = tables[0]
    for other in tables[1:]:
        whole = whole.unionByName(other)
    return selection(whole, where, projections, schema)


def sort_partitions(df: DataFrame, key: Expr | str) -> DataFrame:
    """Each partition by itself in the order of the key."""
    return df.sortWithinPartitions(compile_expr(key, types_of(df))[0].asc())
