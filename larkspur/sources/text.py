"""Text tables: a pipe after every field, no header, no quotes, no escapes, no nulls.

An empty field is the empty string in a string column. Doubles are written with six decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.types import EngineError, Schema, text, types_of


def read_text(spark: SparkSession, path: str, columns: Schema) -> DataFrame:
    """A line with another number of fields, or a field that isn't of its type, fails the read."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value != ''")
    fields = F.split("value", r"\|", -1)
    checked = F.when((F.size(fields) == len(columns) + 1) & (F.element_at(fields, -1) == ""), fields).otherwise(
        F.raise_error(F.concat(F.lit(f"not {len(columns)} fields with a pipe after each: "), F.col("value"))).cast("array<string>")
    )
    made = []
    for k, (name, kind) in enumerate(columns):
        raw = F.col("f").getItem(k)
        if kind.name == "string":
            value = raw
        else:
            value = F.when(raw == "true", True).when(raw == "false", False) if kind.name == "bool" else F.expr(f"try_cast(f[{k}] AS {kind.spark.simpleString()})")
            value = F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no {kind.name} in {name}: "), raw)).cast(kind.spark)).otherwise(value)
        made.append(value.alias(name))
    return lines.select(checked.alias("f"), "value").select(*made)


def text_lines(df: DataFrame) -> DataFrame:
    """The rows as lines, in a column ``value``."""
    types = types_of(df)
    outside = [c for c, t in types.items() if t is None]
    if outside:
        raise EngineError(f"columns {outside} have no text form")
    parts = [x for c, t in types.items() for x in (F.coalesce(text(F.col(f"`{c}`"), t), F.lit("")), F.lit("|"))]
    return df.select(F.concat(*parts).alias("value"))


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    text_lines(df).write.mode(mode).text(path)
