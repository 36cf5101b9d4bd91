"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Stars halve the longest path each time, so this is reached by no graph that fits a cluster; it is an error.
ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    ``edges`` has two columns of one orderable type; loops, repeats and either direction are fine.
    Each round joins every node's larger neighbours, then its smaller ones, to the smallest one. A
    round is aggregates and joins on the node only, its table is written to the shared folder, and
    nothing but counts reaches the driver.
    """
    a, b = edges.columns
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links = stage(links.distinct(), "links")
    for _ in range(ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours of u go to the smallest node around u.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours of u, and u itself, go to the smallest of them.
        small = large.join(lows, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stage(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "links")
        sign = "count(1) AS n, sum(xxhash64(u, v) % 1000000007) AS s"
        if after.selectExpr(*sign.split(", ", 1)).first() == links.selectExpr(*sign.split(", ", 1)).first():
            links = after
            break
        links = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots)
