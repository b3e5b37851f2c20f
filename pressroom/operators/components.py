"""Connected components of an undirected graph held as an edge DataFrame.

Alternating large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds, each one ``groupBy`` (partial
aggregation, so a hub node with millions of edges costs one row per partition) and
one join on the node key (AQE splits a skewed hub partition).  Lineage is cut with a
reliable ``checkpoint()`` into the shared ``spark.checkpoint.dir`` every round, so a
lost executor recomputes one round, not the whole loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.session import checkpoint_dir


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    le = both.filter(F.col("v") <= F.col("u"))
    m = le.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = (le.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
           .unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Converged when every edge points from a node to a smaller root, each node has
    one outgoing edge, and no root has an outgoing edge (one action)."""
    norm = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # per node: out-degree (as the larger end) and whether it is also some edge's root
    ends = (norm.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root"))
            .unionByName(norm.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("root"))))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    bad = per_node.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("root") > 0)))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges``: two columns of comparable node keys.  Returns ``(node, root)`` for
    every node that occurs in an edge; ``root`` is the smallest node of its
    component.  Self-loops are allowed (they only register the node)."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e0 = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = e0.select(F.col("a").alias("node")).unionByName(e0.select(F.col("b").alias("node"))).distinct()
    e = e0.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        e = _small_star(_large_star(e)).checkpoint()
        if _is_star_forest(e):
            break
    star = e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return (nodes.join(star, "node", "left")
            .select("node", F.coalesce("root", "node").alias("root")))
