"""Connected components of a graph given as an edge table, by contraction.

Every round each node points to the neighbour (or itself) that comes first in
a random order of the nodes, and edges are rewritten to the nodes pointed at.
Paths shrink geometrically, so rounds are logarithmic in the longest path; no
task holds a component, because a node's neighbours are only ever reduced to
their minimum (summed up in the map tasks first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the same root for all nodes of a component.

    Loops and repeated edges do no harm; nodes without an edge to another do
    not appear. No edges give an empty table.
    """
    spark = edges.sparkSession
    left = stage(edges.filter("a <> b").select("a", "b").distinct(), "cc-edges")
    roots = None
    step = 0
    while left.limit(1).count():
        step += 1
        rank = F.struct(F.xxhash64(F.lit(step), "b").alias("h"), F.col("b").alias("b"))  # a new order each round
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(rank).alias("m"))
        own = F.struct(F.xxhash64(F.lit(step), "node").alias("h"), F.col("node").alias("b"))
        to = stage(first.select("node", F.least(own, F.col("m")).getField("b").alias("to")), "cc-step")
        ends = [to.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        left = stage(left.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "cc-edges")
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(to.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = stage(roots, "cc-roots")
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")
