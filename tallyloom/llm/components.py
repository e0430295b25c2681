"""Connected components of an edge table, on DataFrames only.

Alternates two star steps until only stars are left, which is looked for before each round: in the large step every node hands its larger
neighbours to its smallest neighbour, in the small step its smaller ones. The tree that is left
links each node to the smallest id of its component. Each round ends in a written table, so a lost
executor costs at most one round. A node with very many edges is met by a pre-aggregated minimum
and by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stored


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars around their smallest nodes: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of one sortable type -> (node, root): for every node with an edge, the smallest id of
    its component. Nulls and loops are left out; an empty table gives an empty one."""
    spark = edges.sparkSession
    now = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        hand = large.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hand.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, stored(small, "edges")
        discard(last)
        release(spark)
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = now.groupBy("v").count().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.join(now.select("u").distinct(), F.col("node") == F.col("u"), "left_anti"))
