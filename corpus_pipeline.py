"""A corpus from documents: toxic ones go, then repeated lines and near copies; sources are mixed, and all is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder and reads it
again for the next. All but the last return the columns of documents.

What holds for every stage: only the columns of documents are read, so extra columns under any name are left behind; a null text is the empty text; a null
doc_id is an id like any other, lower than all integers; an empty table gives an empty result; texts are read whole, however long. What else a stage
does with repeated rows and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import written
from larkspur.llm.jaccard_join import jaccard_components
from larkspur.llm.line_dedup import line_dedup
from larkspur.llm.mixing import mix_documents
from larkspur.llm.packing import pack
from larkspur.llm.toxicity import fit_tables, keep_clean

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(rows: DataFrame) -> DataFrame:
    """given (a row of documents), text -> that row with the text."""
    return rows.select("given.doc_id", "text", "given.lang", "given.source", F.length("text").cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; a score of exactly 0.5 goes as well. Empty texts are scored like others. Repeated rows are scored each, alike, so all
    or none of them stay. Where labels don't suffice to fit a score, all documents stay."""
    docs = docs.select(*COLUMNS)
    return keep_clean(docs, fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more stay in the first only: in that of the least (doc_id, position). No document goes; one may be left without text, and
    an empty text stays as it is. Rows equal in doc_id and text count as one document and get the same text; rows that share a doc_id alone count as several."""
    return _with_text(line_dedup(docs.select(*COLUMNS), min_docs=10, keep_first=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in five-word shingles, the one with the least doc_id stays. Texts without a word are linked with nothing and
    stay. Rows that share a doc_id are versions of one document: they stay or go together."""
    docs = docs.select(*COLUMNS)
    found = jaccard_components(docs, shingle=5, percent=80)
    gone = written(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("did"), "gone").withColumnRenamed("did", "gone_id").hint("shuffle_hash")
    return docs.withColumn("did", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(gone, F.col("did") == F.col("gone_id"), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, repeating; 150 % of all words; at most two repetitions. A row each repetition; one that is taken in part has the first words of
    the text, with one blank between them. Null is a source of its own, last in order. Documents without words are taken no words of and go. Repeated
    rows are taken one by one; ties in the seeded order are by doc_id."""
    return _with_text(mix_documents(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids. Null is a source of its own; repeated rows are packed each; an empty text is one end id."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: The scores and the token ids are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
