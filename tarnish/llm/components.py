"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums leave the map side) and a join of the edges with
one row per node, whose hot nodes Spark's skew join can split. Each round's edges are written to
the shared folder, so a lost executor costs one round's recomputation at most, and the plan stays
short. Nothing but two checksums per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnish.session import discard, materialise


def _hung_below(edges: DataFrame, keep) -> DataFrame:
    """Hang the neighbours that ``keep`` picks under the least of each node and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node but the roots; ``edges`` has long columns ``a`` and ``b``.

    The root is the least node of its component. Empty edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.distinct(), "edges")
    state = _checksum(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(_hung_below(both, F.col("b") > F.col("a")).where("a <> b").distinct(), "large-star")
        # every edge points down here: a node's neighbours are below it
        small = _hung_below(large, F.lit(True)).union(
            large.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct()
        found = materialise(small, "small-star")
        discard(edges, large)
        edges, before = found, state
        state = _checksum(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
