"""Stored tables: Parquet, in the order of a key if they have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.types import EngineError, coerce, spark_schema, types_of
from larkspur.sources.catalog import TableInfo


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _held(spark: SparkSession, path: str) -> str | None:
    """Where the rows are: at the path or, if a swap was cut short, beside it."""
    jvm, at, fs = _files(spark, path)
    return path if fs.exists(at) else f"{path}.old" if fs.exists(jvm.Path(f"{path}.old")) else None


def _swapped(rows: DataFrame, path: str) -> None:
    """Writes beside the path, then swaps: rows that fail leave the table as it was, and so does a crash."""
    spark, path = rows.sparkSession, path.rstrip("/")
    jvm, at, fs = _files(spark, path)
    new, old = jvm.Path(f"{path}.new"), jvm.Path(f"{path}.old")
    rows.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise EngineError(f"can't move the new rows to {path}")
    fs.delete(old, True)


def scan(spark: SparkSession, table: TableInfo) -> DataFrame:
    """All rows; none where nothing was stored yet."""
    path = _held(spark, table.path.rstrip("/"))
    if path is None:
        return spark.createDataFrame([], spark_schema(table.schema))
    return spark.read.schema(spark_schema(table.schema)).parquet(path)


def in_order(df: DataFrame, key: str) -> DataFrame:
    """Ranges of the key, sorted within: file and row-group minima and maxima then tell ranges apart."""
    return df.repartitionByRange(f"`{key}`").sortWithinPartitions(f"`{key}`")


def _fitted(df: DataFrame, table: TableInfo) -> DataFrame:
    if len(df.columns) != len(table.columns):
        raise EngineError(f"{len(df.columns)} columns for table {table.name!r} of {len(table.columns)}")
    types = types_of(df)
    return df.select(*[coerce(F.col(f"`{c}`"), types[c], want).alias(n) for c, (n, want) in zip(df.columns, table.schema, strict=True)])


def store(df: DataFrame, table: TableInfo, mode: str = "overwrite") -> None:
    """overwrite: replaces the rows once all of the new ones are written; append: adds to them (an ordered table gets new ordered files;
    ``compact`` makes one order of all)."""
    rows = _fitted(df, table)
    rows = in_order(rows, table.order_by) if table.order_by else rows
    if mode == "overwrite":
        _swapped(rows, table.path)
    else:
        rows.write.mode(mode).parquet(_held(df.sparkSession, table.path.rstrip("/")) or table.path)


def append(spark: SparkSession, df: DataFrame, table: TableInfo) -> None:
    store(df, table, "append")


def compact(spark: SparkSession, table: TableInfo) -> None:
    """Rewrites an ordered table in one order, another in fewer files; the old files go when the new are complete."""
    rows = scan(spark, table)
    _swapped(in_order(rows, table.order_by) if table.order_by else rows.hint("rebalance"), table.path)


def layout(spark: SparkSession, table: TableInfo) -> DataFrame:
    """A row for each file that holds rows: file, its rows and, of an ordered table, the range of the key, in order of that."""
    rows = scan(spark, table).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    key = [] if table.order_by is None else [F.min(f"`{table.order_by}`").alias("low"), F.max(f"`{table.order_by}`").alias("high")]
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *key).orderBy(*(["low", "high"] if key else []), "file")


#: Different values of a column up to which they are counted exactly.
EXACT = 1000


def statistics(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and how many different values each column has: exactly up to ``EXACT``, about beyond. One pass, and a second over
    columns that seem to have few values, whose partial counts are small."""
    row = df.agg(F.count(F.lit(0)), *[F.approx_count_distinct(f"`{c}`") for c in df.columns]).first()
    counts = dict(zip(df.columns, row[1:], strict=True))
    few = [c for c, n in counts.items() if 0 < n <= 1.3 * EXACT]
    if few:
        exact = df.agg(*[F.count_distinct(f"`{c}`") for c in few]).first()
        counts |= {c: n for c, n in zip(few, exact, strict=True) if n <= EXACT}
    return row[0], counts
