"""Token ids in ORC files.

Documents are range partitioned and sorted by id and encoded in place; ids go to ORC as integer
lists, which the format run-length encodes, with stripes of bounded size, row indexes, and
Bloom filters on doc_id, so that a reader skips files and stripes by metadata and reads the others in parallel.
Each row holds its part and its offset in that part; the parts' totals (one row a part) give the offsets in the corpus.

Defined cases: a null text is the empty text, of the end id alone; null ids sort first and equal
ids by text; an empty table gives an empty file set, read back as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.arrays import portions
from larkspur.llm.common import documents, new_path, text_of
from larkspur.llm.tokens import encoder

ROW = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, stripe_bytes: int = 32 << 20) -> None:
    def encoded(batches):
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for i, data, offsets in portions(batch.column(1)):
                ids, n = enc.encode_ended(data, offsets, end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), lists],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(n.sum())

    ordered = docs.select("doc_id", text_of(docs).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encoded, ROW)
        .write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", 2000)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids; filters on doc_id prune files and stripes."""
    return spark.read.schema(ROW).orc(path)


def id_digests(stored: DataFrame) -> DataFrame:
    """doc_id, part, part_start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def summed(batches):
        for b in batches:
            lists = b.column(4)
            at, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(crc, pa.int64())], names=[*b.schema.names[:4], "ids_crc32"])

    return stored.mapInArrow(summed, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir):
    path = new_path(spark, "ids.orc")
    write_token_ids(documents(spark, sf_dir, "doc_id", "text"), path, tokenizer="word_bpe_49k.json", end_id=2)
    stored = read_token_ids(spark, path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"))
    return id_digests(stored).join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op8_token_files": op8_token_files}
ORACLE: dict[str, str] = {}
