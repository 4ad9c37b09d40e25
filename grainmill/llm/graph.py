"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import Scratch


BROADCAST_ROWS = 500_000
# 1.6 MB: one task goes over these edges sooner than a shuffle starts.
SMALL_ROWS = 100_000


def gathered(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most SMALL_ROWS rows in one partition, so that grouping it needs no shuffle; others as they are."""
    return table.coalesce(1) if rows <= SMALL_ROWS else table


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` for every node of the edges ``a``, ``b``; roots are nodes.

    Each round hooks every node to its smallest neighbour, shortens the paths
    and contracts the graph; the edges shrink by a constant factor if node ids
    are hashes. Nothing but counts reaches the driver. A round's table of nodes
    is broadcast if it has at most BROADCAST_ROWS rows of 16 bytes. Rounds over at
    most SMALL_ROWS edges are tasks of their own, without shuffles.
    """
    edges = edges.where("a <> b")
    size = edges.count()
    rest = scratch.settle(gathered(edges, size).distinct())
    both = rest.select(F.col("a").alias("node")).union(rest.select(F.col("b").alias("node")))
    labels = gathered(both, size).distinct().select("node", F.col("node").alias("root"))
    while size := rest.count():
        rest = gathered(rest, size)
        sides = gathered(rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))), size)
        step = scratch.settle(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        few = step.count() <= BROADCAST_ROWS
        sent = F.broadcast if few else (lambda table: table)
        for _ in range(2):
            further = sent(step.select(F.col("a").alias("to"), F.col("to").alias("further")))
            step = step.join(further, "to").select("a", F.col("further").alias("to"))
        step = scratch.settle(step)
        moved = sent(step.select(F.col("a").alias("root"), "to"))
        labels = scratch.settle(
            labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        ends = [sent(step.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))) for c in ("a", "b")]
        rest = (
            rest.join(ends[0], "a").join(ends[1], "b")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where("a <> b")
            .distinct()
        )
        rest = scratch.settle(rest)
    return labels
