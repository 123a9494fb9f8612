"""Connected components and chains of links, as joins and groupings over tables of edges.

Nothing here holds a component: rounds are DataFrames, and each round's edges are written under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: of ``nodes`` (node) joined by ``edges`` (a, b), the least node of each one's component.

    Large stars and small stars in turn: every node links its larger neighbours, then itself and its smaller ones, to the least of its
    neighbourhood. Edges never grow in number, and their rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    sides = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        both = sides(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        new = cut(small, "edges")
        # Stars, all centres of which are nobody's neighbour, don't change any more.
        if new.select(F.col("a").alias("b")).distinct().join(new.select("b").distinct(), "b", "left_semi").isEmpty() and new.groupBy("b").count().where("count > 1").isEmpty():
            break
        e = new
    return nodes.select("node").distinct().join(new.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, end: where the links (node, up; one for each node at most) lead from each of ``nodes``. A chain ends at the node without
    a link; what leads into a circle ends at the circle's first node on the way, and a node of a circle at itself.

    Pointers are doubled, so rounds grow with the logarithm of the longest chain, of any length.
    """
    known = nodes.select("node").unionByName(links.select("node")).unionByName(links.select(F.col("up").alias("node"))).distinct()
    step = cut(known.join(links, "node", "left").select("node", F.coalesce("up", "node").alias("up")), "links")
    # Nodes that are still reached after as many steps as any chain has are ends and circles.
    far, reached = step, step.select("up").distinct().count()
    while True:
        far = cut(far.select("node", F.col("up").alias("mid")).join(far.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up"), "links")
        now = far.select("up").distinct().count()
        if now == reached:
            break
        reached = now
    last = far.select(F.col("up").alias("node")).distinct().withColumn("stays", F.lit(True))
    walk = cut(step.join(last, "node", "left").select("node", F.when(F.col("stays"), F.col("node")).otherwise(F.col("up")).alias("up")), "links")
    while True:
        new = cut(walk.select("node", F.col("up").alias("mid")).join(walk.select(F.col("node").alias("mid"), F.col("up").alias("next")), "mid").select("node", F.col("next").alias("up"), (F.col("next") != F.col("mid")).alias("moved")), "links")
        done = new.where("moved").isEmpty()
        walk = new.select("node", "up")
        if done:
            break
    return nodes.select("node").distinct().join(walk, "node").select("node", F.col("up").alias("end"))
