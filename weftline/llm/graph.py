"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, remove, written_at


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that it is connected to.

    A node's smallest neighbour is found by an aggregation, combined before its shuffle, and
    joined back, so that the edges of one node never have to come together in one task. Each
    round writes the edges to the shared folder, so the plan stays short and lost executors
    cost one round at most; the round before is removed, and the last one with ``scratch``. The rounds grow with the logarithm of
    the longest chain. Null ends are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession

    def lowest(of: DataFrame) -> DataFrame:
        return of.join(of.groupBy("a").agg(F.min("b").alias("m")), "a")

    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now, at = written_at(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a <> b").distinct()
        small = lowest(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now, next_at = written_at(small.where("a <> b").distinct(), "edges")
        remove(spark, at)
        at = next_at
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if after == before:
            break
        before = after
    if scratch is not None:
        scratch.paths.append(at)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
