"""Connected components over tables: nobody holds the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). -> node, comp: the least node reachable, for every node of an edge.

    Labels fall to the least among neighbours and then jump to the label of the label, so paths halve each
    round. Edges within a component, once told, are dropped: they are relabelled and only those between labels stay.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    live = written(pairs, "edges")
    labels = written(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while live.limit(1).count():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("root"), F.least("a", "low").alias("to"))
        step = written(step, "step")
        jump = step.withColumnsRenamed({"root": "r2", "to": "t2"})
        moved = written(step.join(jump, F.col("to") == F.col("r2"), "left").select("root", F.coalesce("t2", "to").alias("to")), "moved")
        labels = written(labels.join(moved, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        m2 = moved.withColumnsRenamed({"root": "r2", "to": "t2"})
        live = live.join(moved, F.col("a") == F.col("root")).join(m2, F.col("b") == F.col("r2")).select("to", "t2").filter("to != t2")
        live = written(live.select(F.greatest("to", "t2").alias("a"), F.least("to", "t2").alias("b")).distinct(), "edges")
    return labels
