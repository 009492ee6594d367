"""Connected components of an edge list by contraction, with every round kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``c`` for every node of ``edges`` (``a``, ``b``): the smallest node of its component.

    Each round points a node at its least neighbour, follows the pointers twice and contracts the edges; what is left
    of the edges at least halves, so a few rounds do. A node's neighbours are only ever aggregated, never listed.
    """
    left = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("c"))
        for _ in range(2):
            step = kept(step, "step")
            jump = step.select(F.col("v").alias("c"), F.col("c").alias("_c"))
            step = step.join(jump, "c").select("v", F.col("_c").alias("c"))
        step = kept(step, "step")
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("_c"))
        if labels is None:
            labels = step
        else:
            labels = kept(labels.join(jump, "c", "left").select("v", F.coalesce("_c", "c").alias("c")), "labels")
        a, b = (step.select(F.col("v").alias(x), F.col("c").alias(f"_{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").where("_a <> _b")
        left = kept(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("v"), F.col("b").alias("c"))
