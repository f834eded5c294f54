"""Connected components of an edge table by alternating large and small stars.

Each round maps every node's neighbours to the smallest one (first for larger
neighbours, then for smaller ones), which halves long paths; the table never
grows beyond its first size and ends as one star per component.  Each round is
written to the shared folder, so no lineage grows and a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.session import materialize


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of ``u`` to the smallest of them (``u`` included)."""
    if both_ways:        # large star: all neighbours; only larger ones are relinked
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        return (sym.join(low, "u").filter("v > u")
                .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(low, "u")
    return (near.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` longs -> ``(node, root)``, root the smallest node reachable.

    Nodes without an edge to another node don't appear; self loops and
    repeated edges do no harm; an empty table gives an empty table.
    """
    at = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .distinct(), name, partitions=None)
    before = None
    while True:
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        at = materialize(_star(_star(at, True), False), name, partitions=None)
