"""Exact dedup: an extendible-hash index on shared files; owners of key ranges chain texts and compare bytes.

Texts are hashed to 64 bits and counted by hash, so that copies collapse to one index
entry before any shuffle. A directory over the leading bits is doubled until no bucket
holds more than ``capacity`` entries; buckets that fit earlier keep their smaller local depth. The index is written to the shared folder in
bucket order, range partitioned, so that a file owns a range of keys.

A row is looked up by its hash: the slot of its leading bits, the slot's bucket in the directory, its hash in the bucket. Hashes that occur once
are settled there. Rows of the others move to the bucket's owners, where different texts of a hash form its chain, each with its
count and largest id (combined before they move again, so a text of any number of rows is no burden). The chains go back to the index files, and
every row finds its entry in its bucket's chain by comparing bytes: hash collisions can't merge texts.

The directory has at most 2 ** ``max_depth`` slots, which bounds what is broadcast; with more rows than fill it ``capacity`` grows with them.

Defined cases: a null text is empty; all empty texts are equal. A null doc_id ranks below
every id. Rows that agree in text and doc_id are one document: all of them are marked alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, documents, text_of, written


def hash_directory(entries: DataFrame, *, depth: int, capacity: int) -> DataFrame:
    """entries: h. -> slot (leading ``depth`` bits), bucket (leading ``local`` bits), local.

    Each slot joins the shortest prefix that isn't overfull: the leaves after all splits.
    """
    slots = entries.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    cells = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    cells = cells.withColumn("bucket", F.expr(f"shiftright(slot, {depth} - local)"))
    full = cells.groupBy("local", "bucket").agg(F.sum("n").alias("held"))
    fits = full.filter((F.col("held") <= capacity) | (F.col("local") == depth)).select("local", "bucket")
    return cells.join(fits, ["local", "bucket"]).groupBy("slot").agg(F.min(F.struct("local", "bucket")).alias("leaf")).select("slot", "leaf.local", "leaf.bucket")


def hash_index(hashed: DataFrame, *, rows: int, capacity: int = 4096, max_depth: int = 18) -> tuple[DataFrame, DataFrame, int]:
    """hashed: h -> (the index: bucket, local, h, n (rows with that hash); its directory: slot, local, bucket; the directory's depth), both written.

    ``bucket`` is the first slot that a bucket has."""
    capacity = max(capacity, rows >> (max_depth - 2))
    entries = written(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hash_entries")
    depth = min(max_depth, max(1, math.ceil(math.log2(max(2, rows / capacity))) + 2))
    slots = hash_directory(entries, depth=depth, capacity=capacity)
    directory = written(slots.select("slot", "local", F.expr(f"shiftleft(bucket, {depth} - local)").alias("bucket")), "hash_directory")
    owned = look_up(entries, directory, depth).select("bucket", "local", "h", "n")
    index = written(owned.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "hash_index")
    discard(entries)
    return index, directory, depth


def look_up(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """rows with h -> also local and bucket, through the slot. The directory has 2 ** depth rows at most, so it is broadcast."""
    slots = directory.withColumnRenamed("slot", "at_slot")
    return rows.join(F.broadcast(slots), F.shiftrightunsigned("h", 64 - depth) == F.col("at_slot")).drop("at_slot")


def exact_dedup(docs: DataFrame, *, capacity: int = 4096) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = docs.select("doc_id", text_of(docs).alias("t")).withColumn("h", F.xxhash64("t"))
    index, directory, depth = hash_index(hashed.select("h"), rows=docs.count(), capacity=capacity)
    found = look_up(hashed, directory, depth)
    shared = index.filter("n > 1").select(F.col("bucket").alias("i_bucket"), F.col("h").alias("i_h")).hint("shuffle_hash")  # one plan at every size
    owned = found.join(shared, (F.col("bucket") == F.col("i_bucket")) & (F.col("h") == F.col("i_h")))
    texts = owned.groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("bucket").alias("bucket"), F.min("h").alias("h"))
    chains = texts.groupBy("bucket", "h").agg(F.collect_list(F.struct("t", "keep_id", "group_size")).alias("chain"))
    # Written, so that their size is known and the rows of a frequent text can be split in the join.
    chains = written(chains.withColumnsRenamed({"bucket": "c_bucket", "h": "c_h"}).repartitionByRange("c_bucket", "c_h"), "hash_chains")
    discard(index)
    both = found.join(chains, (F.col("bucket") == F.col("c_bucket")) & (F.col("h") == F.col("c_h")), "left")
    entry = F.transform(F.arrays_zip(F.array("t"), F.array("chain")), lambda z: F.filter(z["1"], lambda c: c["t"] == z["0"]).getItem(0)).getItem(0)
    found = both.select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"),
        F.when(F.col("chain").isNotNull(), F.struct(entry["keep_id"].alias("keep_id"), entry["group_size"].alias("group_size"))).alias("e"),
    )
    keep = F.when(F.col("e").isNull(), F.col("doc_id")).otherwise(F.col("e.keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("e.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))


_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": _SQL}
