"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.session import pinned


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """Tie neighbours to the smallest node of each neighbourhood: those above the centre
    (large star), or the centre and those below it (small star). Minima are combined before
    the shuffle and the hub joins are merge joins, which Spark splits and the driver never sees."""
    if not upward:
        links = links.filter("b < a")
    smallest = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    centres = smallest.hint("merge")
    tied = links.filter("b > a").join(centres, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) if upward else (
        links.join(centres, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(smallest.select("a", F.col("m").alias("b")))
    )
    return tied.filter("a != b").distinct()


def _settled(links: DataFrame) -> bool:
    """Every node has one link down, to a node that has none: one aggregate over the nodes."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionAll(links.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max(F.expr("down > 1 OR down = 1 AND up = 1"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node that
    it reaches. Self-links and repeated links are allowed, rows with a null are ignored.

    Each round writes its links to the shared folder, so lineage never grows; the number
    of rounds follows the logarithm of the longest path. Ends when all links are stars.
    """
    nodes = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    current = nodes.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        current = pinned(_star(_both_ways(_star(_both_ways(current), True)), False))
        if _settled(current):
            break
    roots = current.withColumnsRenamed({"a": "node", "b": "root"})
    alone = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return alone.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
