"""Checks of dependency graphs given as edges (node, needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.staging import staged


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to a node that does not exist."""
    return edges.join(nodes.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs")


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("node").join(edges.select("node"), "node", "left_anti")


def first_chain(edges: DataFrame) -> DataFrame:
    """The first node (and what it needs) whose prerequisite has a prerequisite of its own; no row without one."""
    inner = edges.select(F.col("node").alias("needs")).distinct()
    return edges.join(inner, "needs", "left_semi").select("node", "needs").orderBy("node", "needs").limit(1)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle or between cycles: what remains when nodes without open edges on either side are taken away.

    Each round removes a whole layer, so a graph without cycles of depth d takes d rounds. Rounds are written, so
    the plan does not grow.
    """
    left = staged(edges.select("node", "needs").where("node IS NOT NULL AND needs IS NOT NULL").distinct())
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("node").alias("needs")).distinct(), "needs", "left_semi")
        inner = staged(inner.join(inner.select(F.col("needs").alias("node")).distinct(), "node", "left_semi").select("node", "needs"))
        now = inner.count()
        if now == n:
            break
        left, n = inner, now
    return left.select("node").distinct() if n else left.select("node").limit(0)


def cycle_paths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that reach themselves, with the length of the shortest way, of any length or of up to ``most`` edges.

    Breadth-first from all nodes that ``on_cycles`` leaves: a row for each start and node that it reaches, none for each
    path. A start whose way is found goes no further. Rounds are written, so the plan does not grow.
    """
    nodes = staged(on_cycles(edges))
    inner = staged(edges.select("node", "needs").distinct().join(nodes, "node", "left_semi").join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs"))
    n = 1
    front = seen = staged(inner.select(F.col("node").alias("start"), F.col("needs").alias("at"), F.lit(n).alias("n")))
    while most is None or n < most:
        n += 1
        going = front.join(front.where("start = at").select("start"), "start", "left_anti").select("start", F.col("at").alias("node"))
        reached = going.join(inner, "node").select("start", F.col("needs").alias("at")).distinct()
        front = staged(reached.join(seen, ["start", "at"], "left_anti").withColumn("n", F.lit(n)))
        if front.isEmpty():
            break
        seen = staged(seen.unionByName(front))
    return seen.where("start = at").select(F.col("start").alias("node"), F.col("n").alias("length"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes that lie on a cycle: the strongly connected components.

    Forward and backward colouring: the smallest node that reaches a node is its colour; of a colour, the nodes that reach that smallest node back
    are a component. These go, and the rest of each colour is coloured again, among itself. A round has a row for each node and edge that is left,
    and is written, so the plan does not grow; there are as many rounds as the longest shortest way has edges.
    """
    nodes = staged(on_cycles(edges))
    both = lambda e, n: e.join(n.select("node"), "node", "left_semi").join(n.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs")
    left = staged(both(edges.select("node", "needs").distinct(), nodes))
    found = []
    while not left.isEmpty():
        ends = left.select("node").union(left.select(F.col("needs").alias("node"))).distinct()
        colours = _spread(left, staged(ends.withColumn("colour", F.col("node"))))
        same = left.join(colours, "node").join(colours.select(F.col("node").alias("needs"), F.col("colour").alias("theirs")), "needs").where("colour = theirs").select("node", "needs", "colour")
        same = staged(same)
        component = reached = staged(colours.where("node = colour"))
        while not reached.isEmpty():
            back = same.join(reached.select(F.col("node").alias("needs")), "needs").select("node", "colour").distinct()
            reached = staged(back.join(component, "node", "left_anti"))
            component = staged(component.unionByName(reached))
        found.append(component)
        rest = same.join(component, "node", "left_anti").join(component.select(F.col("node").alias("needs")), "needs", "left_anti")
        left = staged(both(rest.select("node", "needs"), on_cycles(rest.select("node", "needs"))))
    if not found:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    several = out.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
    looped = edges.where("node = needs").select(F.col("node").alias("colour")).distinct()  # a component of its own, as one node
    return out.join(several.union(looped).distinct(), "colour", "left_semi").select("node", F.col("colour").alias("component"))


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node along the edges."""
    while True:
        given = edges.join(colours, "node").groupBy(F.col("needs").alias("node")).agg(F.min("colour").alias("given"))
        now = colours.join(given, "node", "left").select("node", F.least("colour", "given").alias("colour"), (F.col("given") < F.col("colour")).alias("changed"))
        now = staged(now)
        colours = now.drop("changed")
        if now.where("changed").isEmpty():
            return colours
