"""Connected components of a graph of links, by rounds that contract it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.session import Scratch


def _trees(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has a lesser neighbour: the end of the path of least neighbours."""
    up = scratch.store(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "up")
    while True:
        beyond = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        jumped = scratch.store(up.select("node", "root").join(beyond, "root", "left").select("node", F.coalesce("beyond", "root").alias("root"), "beyond"), "up")
        moved = jumped.where("beyond is not null").limit(1).count()
        scratch.drop(up)
        up = jumped
        if not moved:
            return up


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of each node's component, for all nodes of links between two nodes.

    Every node points to its least neighbour, if that is less than itself; jumps over the
    pointers make every tree a star.  Links between two trees go on to the next round with
    their roots in place of their ends, so the links left get fewer from round to round, and a
    component that is a star is done after the first.  Minima are partial per task and hot nodes
    meet only in joins that Spark can split.  Each round is written to the shared folder, which
    cuts the lineage and survives lost executors, and dropped when the next is there.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    links, labels = scratch.store(ends, "links"), None
    while True:
        roots = _trees(links, scratch)
        if labels is None:
            new = roots.select("node", F.col("root").alias("component"))
        else:
            moves = roots.select(F.col("node").alias("component"), "root")
            moved = labels.join(moves, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            # the roots of earlier rounds have no row of their own yet
            new = moved.union(roots.select("node", F.col("root").alias("component")))
        new = scratch.store(new, "labels")
        for end in ("a", "b"):
            root = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            links = links.join(root, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
        left = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links, labels = scratch.store(left, "links"), new
        scratch.drop_others(links, labels)
        if not links.limit(1).count():
            scratch.drop(links)
            return labels.union(labels.select("component", "component").distinct())


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, component) after more links (a, b): only those between two components are gone through."""
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce(f"class_{end}", end)).drop(f"class_{end}")
    moves = scratch.store(components(links), "moves")
    beyond = moves.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
    moved = labels.join(beyond, "component", "left").select("node", F.coalesce("beyond", "component").alias("component"))
    return scratch.store(moved.union(moves.join(labels, "node", "left_anti")), "labels")
