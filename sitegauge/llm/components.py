"""Connected components of an edge table by repeated contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _roots(step: DataFrame) -> DataFrame:
    """Follow ``node -> to`` (``to`` <= ``node``) to its end by pointer jumping; the number of rounds is the logarithm of the longest path."""
    while True:
        nxt = step.select(F.col("node").alias("to"), F.col("to").alias("far")).where("to <> far")
        jumped = cut(step.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to"), (F.col("far").isNotNull()).alias("moved")), "jump")
        step = jumped.select("node", "to")
        if not jumped.where("moved").limit(1).count():
            return step


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Table (node, component): the smallest id reachable, for every node that has an edge to another node.

    Every node points to its smallest neighbour or itself, the pointers are followed to their ends, and the edges between
    the ends that differ are contracted until none is left.
    """
    rest = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    out = None
    while rest.limit(1).count():
        both = rest.union(rest.select("b", "a")).toDF("node", "other")
        step = _roots(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("to")))
        if out is None:
            out = step
        else:
            out = cut(out.join(step.toDF("to", "far"), "to", "left").select("node", F.coalesce("far", "to").alias("to")), "labels")
        rest = (
            rest.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        )
        rest = cut(rest, "edges")
    if out is None:
        out = rest.toDF("node", "to")
    return out.toDF("node", "component")
