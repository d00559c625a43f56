"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftwell.llm.common import materialise


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours; counted per task first, so a hub is no hot key."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(smallest, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge table of longs: root is the smallest node of its component.

    Edges may repeat, point either way or be loops; rows with a null end are left out.  Large-star and
    small-star steps alternate, each written to shared storage, until no edge changes: about log(n) rounds.
    """
    plain = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    now = materialise(plain.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        large = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_smallest(large)
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(now, "edges")
    nodes = plain.select(F.col("x").alias("node")).union(plain.select(F.col("y").alias("node"))).distinct()
    joined = nodes.join(now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "node", "left")
    return joined.select("node", F.coalesce("root", "node").alias("root"))
