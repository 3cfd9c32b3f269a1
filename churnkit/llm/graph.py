"""Connected components by repeated contraction, one small set of joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): root is the smallest node reachable.

    Each round points a node at its smallest neighbour (or itself), follows these
    pointers to their ends by doubling and renames the ends of all edges; loops
    and repeats go.  The nodes left at least halve and the loop ends when no
    edge is left; the smallest node of a component is never renamed.  Every table that a join
    reads is written first, so both sides of a join are exchanged and a hub with
    very many edges is split by the adaptive skew join.  Only a row count
    reaches the driver.
    """
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = materialise(e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
                        .select("node", F.col("node").alias("root")), "nodes")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = materialise(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
                         .select("x", F.least("x", "m").alias("m")), "low")
        while True:  # pointer doubling: every node to the end of its chain of minima
            end = to.select(F.col("x").alias("m"), F.col("m").alias("m2"))
            new = materialise(to.join(end, "m").select("x", F.col("m2").alias("m"), (F.col("m") != F.col("m2")).alias("moved")), "chain")
            to = new.select("x", "m")
            if new.where("moved").isEmpty():
                break
        ta, tb = to.toDF("a", "ra"), to.toDF("b", "rb")
        e = materialise(e.join(ta, "a").join(tb, "b").where("ra <> rb")
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        label = materialise(label.join(to.toDF("root", "r"), "root", "left")
                            .select("node", F.coalesce("r", "root").alias("root")), "labels")
    return label
