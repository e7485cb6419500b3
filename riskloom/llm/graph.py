"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); nodes of one component share one root.

    Each round hooks every node to the least of itself and its neighbours,
    renames both ends of every edge, and drops loops and repeats.  Order is
    that of a hash of the node, so that paths shrink by a constant share a
    round.  Minima are partially aggregated and renaming is a plain join, so
    no hub meets all its neighbours in one task; only edge tables are kept,
    each in the checkpoint folder.  No edges give no rows.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).getField("n").alias("root")).withColumnRenamed("a", "node"))
        steps.append(to)
        left, right = to.toDF("a", "ra"), to.toDF("b", "rb")
        renamed = edges.join(left, "a").join(right, "b")
        edges = cut(renamed.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for to in steps[1:]:
        out = out.join(to.toDF("root", "higher"), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return out
