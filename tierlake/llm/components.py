"""Connected components of a graph of long ids, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleanup, settle


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node of its component), for the nodes of links.

    Every round, each node's roots are hooked to the least root next to it, then
    paths are halved: rounds grow with the logarithm of the longest path, not
    with its length, and no component is ever gathered in one place.
    """
    with cleanup(links.sparkSession):
        edges = settle(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        nodes = edges.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        roots = settle(nodes.select("node", F.col("node").alias("root")))
        while True:
            rx, ry = roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
            across = settle(edges.join(rx, "x").join(ry, "y").where("rx != ry").select(F.least("rx", "ry").alias("low"), F.greatest("rx", "ry").alias("high")).distinct())
            if across.isEmpty():
                return settle(roots, keep=True)
            hooks = settle(across.groupBy("high").agg(F.min("low").alias("low")))
            while True:  # low < high, so hooks form a forest: jump until every hook is at its root
                up = hooks.select(F.col("high").alias("low"), F.col("low").alias("next"))
                jumped = settle(hooks.join(up, "low", "left").select("high", F.coalesce("next", "low").alias("low"), F.col("next").isNotNull().alias("moved")))
                done = jumped.where("moved").isEmpty()
                hooks = jumped.drop("moved")
                if done:
                    break
            at = hooks.select(F.col("high").alias("root"), F.col("low").alias("to"))
            roots = settle(roots.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
