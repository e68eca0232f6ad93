"""Line dedup: sorted hash ranges say which lines go; bitmaps, not texts, carry the answer.

Lines become (key hash, document, position) rows of a few dozen bytes. They are range
partitioned by hash and document, so that one frequent key spreads over many ranges, and sorted
within each by position. One pass over a sorted range streams a key's occurrences in a document and
tells the first from the later ones; a partial aggregate then reduces each range to one row a key (first
occurrence, number of documents) before anything is shuffled by key alone. What stays returns as a sparse
bitmap a document: words of 64 lines, those of which all lines stay left out. It is applied to the lines in place.

Keys are compared by two independently seeded 64-bit hashes.

Defined cases: null and empty texts have one empty line; keys shorter than ``min_key``
always stay; rows that agree in doc_id and text are one document and get one answer each; rows
that share only a doc_id (null too) are different documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bare, discard, documents, text_of, written


def line_key(line: Column) -> Column:
    """A key that lines without blanks at their ends share if they differ in the case of A-Z alone.

    lower() does that for ASCII. Of other lines it gets the bytes as Latin-1: besides A-Z that moves the first bytes of two-byte
    characters alone, to values that only longer characters start with, so different lines keep different keys.
    (translate() would make an object a character.)
    """
    return F.lower(F.when(F.octet_length(line) == F.length(line), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1")))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of(docs).alias("t")).select(
        "doc_id", F.xxhash64("t").alias("row"), F.split("t", "\n", -1).alias("lines")
    )


def line_bitmaps(docs: DataFrame, *, min_docs: int, keep_first: bool, min_key: int = 1) -> DataFrame:
    """Documents that lose lines: doc_id, row (hash of the text), ``keep``: [(word, mask)], bit p of
    word w stands for line 64 w + p; words that aren't listed keep all their lines.

    A key in at least ``min_docs`` documents goes: everywhere, or with ``keep_first``
    but for its first line by (doc_id, position). ``min_docs=1, keep_first=True`` is plain line dedup.
    """
    keyed = (
        _lines(docs)
        .select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "row", "pos", bare(F.col("line")).alias("bare"))
        .filter(F.length("bare") >= max(min_key, 0))
        .select("doc_id", "row", "pos", line_key(F.col("bare")).alias("key"))
        .select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row", "pos"
        )
    )
    keyed = written(keyed, "line_keys")  # the ranges are sampled from this, not from the texts again
    ranged = keyed.repartitionByRange("h1", "h2", "doc_id", "row").sortWithinPartitions("h1", "h2", "doc_id", "row", "pos")
    # The ranges hold a key's rows of one document together and in order: no exchange and no sort here. Rows that repeat tie.
    in_doc = Window.partitionBy("h1", "h2", "doc_id", "row").orderBy("pos")
    streamed = written(ranged.select("*", (F.row_number().over(in_doc) == 1).alias("opens"), F.rank().over(in_doc).alias("nth")), "line_ranges")
    discard(keyed)
    wanted = [F.sum(F.col("opens").cast("int")).alias("n"), F.max("nth").alias("most")]
    if keep_first:
        wanted.append(F.min(F.when(F.col("opens"), F.struct("doc_id", "row"))).alias("first"))
    keys = streamed.groupBy("h1", "h2").agg(*wanted).filter(F.col("n") >= min_docs)
    if keep_first:
        keys = keys.filter((F.col("n") > 1) | (F.col("most") > 1))
    # Written, so that its size is known (it is broadcast only if small) and a frequent key's rows can be split in the join.
    counts = written(keys.drop("n", "most"), "line_counts")
    hit = streamed.join(counts, ["h1", "h2"])
    if keep_first:
        is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("nth") == 1)
        hit = hit.filter(~is_first)
    words = hit.groupBy("doc_id", "row", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    masks = words.select("doc_id", "row", F.struct(F.col("word").cast("int").alias("word"), F.bitwise_not("mask").alias("mask")).alias("w"))
    bitmaps = written(masks.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("w")).alias("keep")), "line_bitmaps")
    discard(streamed, counts)
    return bitmaps


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row: doc_id, ``text`` of the lines that stay, n_lines, n_dropped. Other columns of ``docs`` are kept
    in the struct ``given``."""
    left = docs.select(
        F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), text_of(docs).alias("t")
    ).withColumn("row", F.xxhash64("t"))
    # Bitmaps are a small fraction of the texts: they are hashed, so that the texts need no sort.
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("row").alias("b_row"), "keep").hint("shuffle_hash")
    both = left.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("row") == F.col("b_row")), "left")
    gone = F.flatten(
        F.transform(
            "keep",
            lambda x: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.expr("0L") == F.call_function("shiftright", x["mask"], k).bitwiseAND(F.lit(1))),
                lambda k: x["word"] * 64 + k,
            ),
        )
    )
    n_lines = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    both = both.select("doc_id", "given", "t", n_lines.alias("n_lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone"))
    pairs = F.arrays_zip(F.array(F.split("t", "\n", -1)), F.array(stay))
    rest = F.transform(pairs, lambda z: F.array_join(F.transform(z["1"], lambda i: F.get(z["0"], i)), "\n"))
    return both.select(
        "doc_id", "given",
        F.when(F.size("gone") == 0, F.col("t")).otherwise(rest.getItem(0)).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, *, min_docs: int = 10, keep_first: bool = False, min_key: int = 1) -> DataFrame:
    return drop_lines(docs, line_bitmaps(docs, min_docs=min_docs, keep_first=keep_first, min_key=min_key))


def op2_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir, "doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {"op2_line_dedup": _SQL}
