"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanlake.session import cut_lineage

MOST_ROUNDS = 60


def _to_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Least neighbour of each node or the node itself, summed in tasks before the shuffle."""
    return edges.groupBy(node).agg(F.least(F.min(other), F.col(node)).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable from each node of ``edges`` (``a, b``).

    Each round links every node's larger neighbours, then its smaller ones, to the least node seen;
    about log(nodes) rounds, each written to the shared folder.  Only a count reaches the driver.
    Edges may come in any direction and number; a node without edges is not in the result.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), "links")
    for _ in range(MOST_ROUNDS):
        # Larger neighbours to the least of all neighbours.
        both = now.union(now.select("v", "u")).toDF("n", "o")
        large = (both.where("o > n").join(_to_least(both, "n", "o"), "n")
                 .select(F.col("o").alias("u"), F.col("least").alias("v")).distinct())
        # Smaller neighbours, and the node itself, to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
                 .union(least.select("u", F.col("least").alias("v"))).distinct())
        after = cut_lineage(small, "links")
        moved = after.join(now, ["u", "v"], "left_anti").limit(1).count()
        same_size = moved == 0 and after.count() == now.count()
        now = after
        if same_size:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
