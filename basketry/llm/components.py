"""Connected components of an edge table, on the executors.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
is a grouped minimum (combined before the shuffle) and a join that gives every
edge the minimum of its node.  Nodes with very many edges (more than ``HOT``,
and more than one ``MOST``-th of all) get theirs from a broadcast table, which
therefore has fewer than ``MOST`` rows whatever the input; so the shuffled join
never gathers more edges of one node than that in a task.  The edge table is
checkpointed after each step.  The driver sees two numbers a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: A node is hot with more edges than this, and more than this share of all edges: at most MOST nodes can be.
HOT, MOST = 1000, 50_000


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` with the minimum m of their node u; low: (u, m, n edges of u), checkpointed."""
    seen = low.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    bound = max(HOT, (seen.total or 0) // MOST)
    if (seen.most or 0) <= bound:
        return edges.join(low.select("u", "m"), "u")
    hot = F.broadcast(low.where(F.col("n") > bound).select("u", "m"))
    rest = edges.join(hot, "u", "left_anti").join(low.where(F.col("n") <= bound).select("u", "m"), "u")
    return rest.unionByName(edges.join(hot, "u"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v, checkpointed.  The same components with neighbours hung on minima; pairs may repeat."""
    n = F.count(F.lit(1)).alias("n")
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), n))
        out = _with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), n))
        out = _with_low(edges, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return each.where("up > 1 or up = 1 and root = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest reachable node of every node with an edge.

    ``edges`` may hold repeats, loops and either direction; rows with a null
    end are ignored.  An empty table gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    e = checkpointed(e.where("not x and not y and u <> v").select("u", "v").distinct())
    while not _stars_only(e):
        e = checkpointed(_star(checkpointed(_star(e, True).distinct()), False).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
