"""Connected components of an edge table by alternating stars, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spent, written


def connected(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is its component's smallest node.

    Each round points the larger neighbours of every node at its smallest one, then does the same
    for the smaller neighbours; rounds needed grow with the logarithm of a component's size. Every
    round is a grouped minimum and a join, written to the shared folder. No edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = written(spark, e, "edges")
    nodes = e

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = state(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("s")
        )
        last, e = e, written(spark, small.select("s.u", "s.v").filter("u <> v").distinct(), "edges")
        if last is not nodes:
            spent(spark, last)
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
