"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Sources share ``share`` times all words by weight. A source never gives more than ``max_epochs``
times its words; what it can't take is shared again by weight among the others until
nobody is above. With the sources in order of cap / weight that fixed point is one pass: at the
first source whose cap is not below the level (rest of the budget) / (rest of the weights), the level is found.

Every document of a source is taken ``floor(target / source_size)`` times whole, by the target rounded to words. The
fraction left over takes documents in the order of a seeded hash until its words are reached,
the last one in part, so the words taken meet the target to within one. The order is cut
into ``2 ** bits`` hash ranges a source: their sums say in which the fraction ends, and only that range is sorted.

Defined cases: null texts have size 0; null is a source of its own, last in order; sources
without words get target 0; rows that repeat are taken one by one (equal ones in either
order, with equal results); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import documents, words_of, written


def water_fill(sources: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sources: source, source_size -> also weight, target. One row a source; weights repeat in code point order."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("rank", F.row_number().over(everything)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    capped = listed.withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole) * float(share)
        - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", level)
    levels = levels.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    found = levels.withColumn("found", F.first("open", ignorenulls=True).over(whole))
    target = F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("weight")), F.col("cap"))
    return found.select("source", "source_size", "weight", target.alias("target"))


def _plan(docs: DataFrame, *, weights, share: float, max_epochs: float, seed: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row a document: doc_id, source, size, h, bucket; a row a source: sizes, target, ``whole``, and the bucket
    ``cut`` in which the fraction ends, with the words of it still free there; documents of those buckets: source, h,
    rows that are equal in these, words taken of all of them)."""
    sizes = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _order(seed).alias("h"))
    sizes = written(sizes.withColumn("bucket", _bucket(bits)), "sizes")
    buckets = written(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")), "buckets")
    per_source = buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    targets = water_fill(per_source, weights=weights, share=share, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.expr("rounded div source_size")).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("rounded", F.round("target").cast("long")).withColumn("whole", whole), "targets")
    targets = targets.withColumn("left", F.col("rounded") - F.col("whole") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0))).withColumnRenamed("source", "b_source")
    t = targets.withColumnRenamed("source", "c_source")
    ends = before.join(t.select("c_source", "left"), F.col("b_source").eqNullSafe(F.col("c_source")))
    ends = ends.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("in_bucket")))
    ends = ends.select("b_source", F.col("bucket").alias("cut"), (F.col("left") - F.col("before")).alias("room"))
    cuts = written(t.join(ends, F.col("c_source").eqNullSafe(F.col("b_source")), "left").drop("b_source", "left", "rounded"), "cuts")
    within = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_end = sizes.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("cut")))
    start = F.coalesce(F.sum("size").over(within), F.lit(0))
    parts = at_end.select("source", "h", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - start)).alias("part"))
    return sizes, cuts, written(
        parts.groupBy(F.col("source").alias("e_source"), F.col("h").alias("e_h")).agg(F.count(F.lit(1)).alias("e_rows"), F.sum("part").alias("e_part")), "ends"
    )


def _order(seed: int):
    """The first 60 bits of an MD5 over seed, doc_id and text, which SQL has as well."""
    told = F.concat_ws(" ", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def _bucket(bits: int):
    return F.shiftright("h", 60 - bits).cast("int")


def _taken(rows: DataFrame, cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """rows: source, size, h, bucket -> also whole, part. Cuts and ends are tables of known size: small ones are broadcast."""
    ended = (F.col("h") == F.col("e_h")) & F.col("source").eqNullSafe(F.col("e_source"))
    both = rows.join(cuts, F.col("source").eqNullSafe(F.col("c_source"))).join(ends, ended, "left")
    before = F.lit(0)
    if ends.filter("e_rows > 1").limit(1).count():  # rows that repeat there, and only these, are numbered
        repeated = F.coalesce(F.col("e_rows") > 1, F.lit(False))
        before = F.col("nth") * F.col("size")
        nth = F.row_number().over(Window.partitionBy("source", "h").orderBy("size")) - 1
        both = both.filter(~repeated).withColumn("nth", F.lit(0)).unionByName(both.filter(repeated).withColumn("nth", nth))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("e_part", F.lit(0)) - before))
    part = F.when(F.col("bucket") < F.col("cut"), F.col("size")).when(F.col("bucket") == F.col("cut"), last).otherwise(F.lit(0))
    return both.withColumn("part", part.cast("long"))


def mixture(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, bits: int = 12) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, ``whole`` (repetitions), ``part``
    (words of one more repetition), ``taken`` (words in all)."""
    sizes, cuts, ends = _plan(docs, weights=weights, share=share, max_epochs=max_epochs, seed=seed, bits=bits)
    return _taken(sizes, cuts, ends).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken")
    )


def mix_documents(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, bits: int = 12) -> DataFrame:
    """The documents as mixed: a row for each repetition, with the columns of ``docs``; the text of one taken in part
    has the first words of the whole. Texts don't move: a row needs only its source's cut."""
    _, cuts, ends = _plan(docs, weights=weights, share=share, max_epochs=max_epochs, seed=seed, bits=bits)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), "doc_id", "source", "text")
    sized = given.withColumns({"size": F.size(words_of(F.col("text"))).cast("long"), "h": _order(seed)}).withColumn("bucket", _bucket(bits))
    took = _taken(sized, cuts, ends).withColumn("last", F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    repeats = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.col("last"))
    rows = took.select("given", "text", "size", F.explode(repeats).alias("n")).filter("n > 0")
    text = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(words_of(F.col("text")), 1, F.col("n").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select("given", text.alias("text"))


def op3_mixing(spark, sf_dir):
    return mixture(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mixing": op3_mixing}
#: Shares by the definition: a source is capped if the level of those that are left, in order of cap / weight, is above its own.
_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
                  CAST('0x' || substr(md5('0 ' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CAST([5, 2, 1][(nth - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS k FROM w),
levels AS (SELECT r.k, ((SELECT 1.5::DOUBLE * sum(source_size) FROM r) - coalesce(sum(o.cap) FILTER (o.k < r.k), 0)) / sum(o.weight) FILTER (o.k >= r.k) AS level,
                  any_value(r.cap) AS cap, any_value(r.weight) AS weight FROM r, r AS o GROUP BY r.k),
found AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM found) * weight), cap) AS target FROM r),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source
"""
ORACLE = {"op3_mixing": _SQL}
