"""Graph algorithms on edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConverged
from .iterate import checkpoint, forget, rounds


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, dist for all nodes reached from seeds (node).  Each round joins the frontier only and writes the new
    frontier only: a neighbour of a level lies in it, in the one before or in the next one, so that nothing else
    that has been seen needs to be looked at."""
    both = checkpoint(undirected(edges))
    levels = [checkpoint(seeds.select("node").distinct().withColumn("dist", F.lit(0).cast("long")))]
    for k in range(1, max_rounds + 1):
        near = both.join(levels[-1].select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        known = levels[-1] if k == 1 else levels[-1].union(levels[-2])
        new = checkpoint(near.join(known, "node", "left_anti").withColumn("dist", F.lit(k).cast("long")))
        if new.isEmpty():
            out = levels[0]
            for f in levels[1:]:
                out = out.union(f)
            return out
        levels.append(new)
    raise NotConverged(f"frontier after {max_rounds} rounds")


def pagerank(edges: DataFrame, nodes: DataFrame, n_rounds: int, damping: float = 0.85, dangling: str = "spread", cut_every: int = 1) -> DataFrame:
    """node, rank after n_rounds updates from 1/n.  Multi-edges count.  dangling: "spread" deals the rank of nodes
    without out-edges evenly, "lost" drops it.

    A round is one join and one sum over one table of arcs, and reads the ranks once.  What dangling nodes lose is
    kept at a node of its own (sink): rank = own + damping / n * lost, and as shares are linear, its arcs to the
    other nodes stand for the even deal.  Arcs of share 0 from each node to itself keep nodes that nobody links to.
    """
    first = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).first()
    n, some = first["n"], F.lit(first["node"]).cast(nodes.schema["node"].dataType)
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    spread, no, yes = dangling == "spread", F.lit(False), F.lit(True)
    e = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("degree"))
    real = checkpoint(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")))
    arc = lambda d, a, sa, b, sb, share: d.select(a.alias("src"), sa.alias("from_sink"), b.alias("dst"), sb.alias("to_sink"), share.alias("share"))
    arcs = arc(real, F.col("src"), no, F.col("dst"), no, F.col("share")).union(arc(nodes, F.col("node"), no, F.col("node"), no, F.lit(0.0)))
    if spread:
        lone = nodes.join(real.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        arcs = arcs.union(arc(lone, F.col("node"), no, some, yes, F.lit(1.0)))
        arcs = arcs.union(arc(real.groupBy("dst").agg(F.sum("share").alias("s")), some, yes, F.col("dst"), no, F.col("s") * F.lit(damping / n)))
        arcs = arcs.union(arc(lone.agg(F.count(F.lit(1)).alias("c")), some, yes, some, yes, F.col("c") * F.lit(damping / n)))
    # arcs into a node, summed to fewer rows; what is sorted alike is packed well
    arcs = checkpoint(arcs.groupBy("src", "from_sink", "dst", "to_sink").agg(F.sum("share").alias("share")))

    def update(now: DataFrame) -> DataFrame:
        got = now.join(arcs, (now["node"] == arcs["src"]) & (now["sink"] == arcs["from_sink"])).groupBy("dst", "to_sink").agg(F.sum(F.col("own") * F.col("share")).alias("got"))
        return got.select(F.col("dst").alias("node"), F.col("to_sink").alias("sink"), F.when(F.col("to_sink"), F.col("got")).otherwise(F.lit((1 - damping) / n) + damping * F.col("got")).alias("own"))

    end = rounds(nodes.select("node", no.alias("sink"), F.lit(1.0 / n).alias("own")), update, n_rounds, cut_every)
    if not spread or not n_rounds:
        return end.select("node", F.col("own").alias("rank"))
    end = checkpoint(end)
    lost = end.where("sink").select(F.col("own").alias("lost"))  # one row at most
    return end.where("not sink").join(F.broadcast(lost), how="left").select("node", (F.col("own") + F.lit(damping / n) * F.coalesce("lost", F.lit(0.0))).alias("rank"))


def contracted(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpoint, drop: Callable[[DataFrame], None] = forget) -> DataFrame:
    """node, label for the nodes of edges (a, b) that link different nodes: label is one node of the component.

    Each round every node takes the neighbour of least hash, then that one's, as its label; edges become pairs of
    labels, equal ends go, and each pair stays once.  So edges shrink by a factor from round to round, whatever the
    order of the nodes, and a dense group is a star after the first.  cut writes a table, drop deletes one that was
    replaced."""
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("y"))).alias("m"))
        near = cut(low.select(F.col("x").alias("node"), F.when(F.col("m.h") < F.xxhash64("x"), F.col("m.y")).otherwise(F.col("x")).alias("to")))
        two = cut(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"))
        drop(near)
        a, b = two.select(F.col("node").alias("a"), F.col("label").alias("la")), two.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        new = cut(e.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        drop(e)
        e = new
        steps.append(two)
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    drop(e)
    out = steps.pop()
    while steps:
        first = steps.pop()
        new = cut(first.join(out.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label")))
        drop(first)
        drop(out)
        out = new
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of an edge."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = contracted(ends)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    least = least.select("label", F.least("label", "least").alias("least"))
    linked = found.join(least, "label").select("node", F.col("least").alias("label"))
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return linked.union(alone.select("node", F.col("node").alias("label")))


def union_find_merges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The edges that join two components when taken in arrival order: the minimum spanning forest for weights
    that are the places in that order.

    Boruvka's algorithm on contracted edges: each round every label takes its least edge, which is of the forest
    whether or not labels are whole components yet; labels hook to the other end, and to that one's; edges become
    pairs of labels of which the least stays.  No task sees more than its share of the edges."""
    place = F.struct(*[F.col(c).alias(c) for c in order])
    e = edges.where("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct(place.alias("place"), F.col("src").alias("src"), F.col("dst").alias("dst")).alias("r"))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    e = checkpoint(e.groupBy(*pair).agg(F.min("r").alias("r")))
    taken: list[DataFrame] = []
    while not e.isEmpty():
        sides = e.select(F.col("a").alias("x"), F.struct("r", F.col("b").alias("y")).alias("m")).union(e.select("b", F.struct("r", F.col("a").alias("y"))))
        best = checkpoint(sides.groupBy("x").agg(F.min("m").alias("m")).select("x", "m.y", "m.r"))
        taken.append(best.select("r.*").distinct())
        other = best.select(F.col("x").alias("y"), F.col("y").alias("z"))
        # two labels that take each other: the lesser one stays
        hook = best.join(other, "y").select(F.col("x").alias("node"), F.when((F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("to"))
        two = checkpoint(hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"))
        a, b = two.select(F.col("node").alias("a"), F.col("label").alias("la")), two.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        new = e.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "r")
        e = checkpoint(new.groupBy("a", "b").agg(F.min("r").alias("r")))
    if not taken:
        return edges.limit(0).select(*order, "src", "dst")
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out.distinct().select("place.*", "src", "dst")


def union_find_exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same for one small group in one task, edge by edge (for applyInPandas)."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (a, b) in enumerate(zip(pdf["src"], pdf["dst"])):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return pdf.iloc[keep]
