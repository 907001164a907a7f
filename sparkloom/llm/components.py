"""Connected components of a link table by contraction.

Every node hangs on its smallest neighbour, if that is smaller than itself; parents are replaced by theirs until
all nodes of a tree hang on its root; links between trees are then links between roots, and the same again
joins these. Each step is a grouped minimum (combined map-side) or an equi-join of written tables, whose sides
have an exchange of their own: Spark splits a hub with very many links into several tasks, and no link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged


def _rooted(parents: DataFrame) -> DataFrame:
    """The written ``parents(node, component)`` of a forest -> (node, component, moved), component being each tree's root; written."""
    state = parents
    while True:
        above = state.select(F.col("node").alias("component"), F.col("component").alias("top"))
        up = state.select("node", "component").join(above, "component", "left")
        after = staged(up.select("node", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")), "trees")
        discard(state)
        state = after
        if state.where("moved").isEmpty():
            return state


def _joined(comp: DataFrame, tops: DataFrame) -> DataFrame:
    """Components once those in ``tops`` are joined; nodes that ``comp`` doesn't have come from ``tops``."""
    above = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = comp.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return staged(moved.unionByName(tops.join(comp.select("node"), "node", "left_anti").select("node", "component")), "components")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component being the smallest node reached.

    Nodes without a link to another node do not appear. Null ends and self-links are ignored;
    repeated links count once; an empty table gives an empty result. The result is a written table.
    """
    links = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    parents = staged(links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "trees")
    forest = links.count() == parents.count()
    trees = _rooted(parents)
    roots = trees.select(F.col("component").alias("node"), "component").distinct()
    comp = staged(trees.select("node", "component").unionByName(roots), "components")
    discard(trees)
    if not forest:
        comp = extended(comp, links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    discard(links)
    return comp


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comp`` once ``links(a, b)`` are added. Both are written tables; ``comp`` is deleted if it changes."""
    one = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    rest = staged(ends.where("a <> b").distinct(), "links")
    if not rest.isEmpty():
        tops = connected_components(rest)
        out = _joined(comp, tops)
        discard(comp)
        discard(tops)
        comp = out
    discard(rest)
    return comp
