"""The four scalar types, their lattice, text forms and conversions.

Every rule here is a choice of Spark columns made before the plan exists; casts are explicit, so results don't depend on
how Spark would coerce by itself, nor on its ANSI setting (integer overflow and doubles beyond an int excepted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EngineError(Exception):
    """Any fault of a query, told before it runs."""


class TypeMismatch(EngineError, TypeError):
    pass


class UnknownColumn(EngineError):
    pass


@dataclass(frozen=True)
class Type:
    """name: int, double, string or bool. wide: an int of 64 bits, as keys may be."""

    name: str
    wide: bool = False

    @property
    def spark(self) -> T.DataType:
        if self.name == "int":
            return T.LongType() if self.wide else T.IntegerType()
        return {"double": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType()}[self.name]

    @property
    def to_int(self) -> bool:
        return self.name == "int"

    @property
    def to_double(self) -> bool:
        return self.name in ("int", "double")


INT, LONG, DOUBLE, STRING, BOOL = Type("int"), Type("int", True), Type("double"), Type("string"), Type("bool")
NAMES = {"int": INT, "long": LONG, "bigint": LONG, "double": DOUBLE, "string": STRING, "bool": BOOL}
_OF_SPARK = {
    T.ByteType: INT, T.ShortType: INT, T.IntegerType: INT, T.LongType: LONG, T.FloatType: DOUBLE,
    T.DoubleType: DOUBLE, T.StringType: STRING, T.BooleanType: BOOL,
}

Schema = list[tuple[str, Type]]


def schema(*columns: tuple[str, str | Type]) -> Schema:
    """schema(("a", "int"), ("b", "string"))"""
    return [(n, t if isinstance(t, Type) else NAMES[t.lower()]) for n, t in columns]


def spark_schema(columns: Schema) -> T.StructType:
    return T.StructType([T.StructField(n, t.spark, True) for n, t in columns])


def types_of(df: DataFrame) -> dict[str, Type | None]:
    """Types by column; None for one outside the four (it may be carried, not computed with)."""
    if len(set(df.columns)) < len(df.columns):
        raise EngineError(f"column names occur twice: {sorted(c for c in set(df.columns) if df.columns.count(c) > 1)}")
    return {f.name: _OF_SPARK.get(type(f.dataType)) for f in df.schema.fields}


def text(value: Column, kind: Type) -> Column:
    """The text form: decimal ints, six decimals for doubles, true and false."""
    if kind.name == "string":
        return value
    if kind.name == "double":
        return F.format_string("%.6f", value)
    return value.cast("string")


def coerce(value: Column, have: Type, want: Type) -> Column:
    """An expression as the column of an output table: numbers into each other (doubles lose their fraction), anything into
    text; the rest is an error."""
    if have.name == want.name:
        return value if have == want else value.cast(want.spark)
    if want.name == "string":
        return text(value, have)
    if have.to_double and want.to_double:
        return value.cast(want.spark)
    raise TypeMismatch(f"{have.name} can't be stored as {want.name}")
