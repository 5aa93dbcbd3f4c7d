"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  Large: every larger neighbour of a node is linked to the least
    node around; small: every node not larger is."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("u > v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); root is the least node of its
    component.

    Star contractions turn the links into one star per component; the number of
    rounds grows with the logarithm of the longest chain.  Every round is checkpointed
    in the shared folder.  Nodes with very many links are met by aggregation with
    map-side combine and by joins whose skewed side Spark splits.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u <> v").distinct())
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                          ).first()
        if tuple(found) == state:
            break
        state = tuple(found)
        if not state[0]:
            break
        edges = cut(_stars(_stars(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
