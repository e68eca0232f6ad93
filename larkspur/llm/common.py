"""What the corpus operators share: the folder all executors see, and small column helpers.

Conventions that hold for every operator here:

* Only the columns an operator names are read; whatever else a table has, under
  whatever names, is ignored, so extra columns can't clash with computed ones.
* A null text is the empty text unless an operator says otherwise.
* A null ``doc_id`` is an id like any other, lower than all integers.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and the code points 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. There is no other to fall back to on a cluster;
    where all run in one process (a local master, as in tests) a temporary folder of this machine does."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed as the driver ends, if not before."""
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}/{name}"
    at, system = _folder(spark, path)
    system.deleteOnExit(at)
    return path


#: While a table is written: texts are large, so few are read at once; and shuffle files of a finished write are of no more use.
_WRITING = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _writing(spark: SparkSession, batch: int):
    settings = _WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there.

    batch: rows of a record batch, for what of it runs in Python; texts are large, so fewer than Spark's own setting.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _writing(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._larkspur_path = path
    return table


def written_in_buckets(df: DataFrame, name: str, by: tuple[str, ...], buckets: int) -> DataFrame:
    """As ``written``, bucketed: joins by these columns leave the table's rows where they are. As many buckets as the session has shuffle
    partitions, or a multiple: rows that were shuffled by the same columns come from one task a bucket. The catalog's entry is dropped at once; only the files and the returned DataFrame remain."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = shuffled * max(1, min(-(-buckets // shuffled), 100_000 // shuffled))
    entry = f"larkspur_{uuid.uuid4().hex}"
    with _writing(spark, 1000):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *by).saveAsTable(entry)
    table = spark.table(entry)
    table.schema  # noqa: B018  resolved before the entry goes
    spark.sql(f"DROP TABLE {entry}")
    table._larkspur_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more: what came of them is written itself."""
    for t in tables:
        at, system = _folder(t.sparkSession, t._larkspur_path)
        system.delete(at, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def bare(text: Column) -> Column:
    """The text without blanks at its ends. btrim() with a list of characters makes arrays as long as the text, so only texts that need it get there."""
    edged = [F.startswith(text, F.lit(c)) | F.endswith(text, F.lit(c)) for c in BLANKS]
    return F.when(reduce(lambda a, b: a | b, edged), F.btrim(text, F.lit(BLANKS))).otherwise(text)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` as an array; no text or no word gives an empty one."""
    return let(bare(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def plain_words(text: Column) -> Column:
    """The words with one blank between them; cheaper than words_of() where only their text is of use."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return let(F.btrim(text), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
