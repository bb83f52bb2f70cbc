"""Graph algorithms on edge lists: PageRank and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.frame import Frame
from framewise.plans.scale import cut


class PageRank:
    """r = (1 - d) + d sum of r / out-degree over the in-links, from 1; parallel edges count; without in-links a rank stays 1."""

    def __init__(self, damping_factor: float = 0.85, max_iters: int = 100) -> None:
        self.damping_factor, self.max_iters = damping_factor, max_iters

    def transform(self, data: Frame, outlink_col: str, inlink_col: str, cut_every: int = 5) -> Frame:
        """(Vertex, Rank), highest first; edges with a null end don't count.

        Edges carry their out-degree share and are laid out by source once; a step joins them with the
        ranks and sums by target, map-side first. Lineage is cut every few steps.
        """
        df = data.df if isinstance(data, Frame) else data
        edges = df.select(F.col(f"`{outlink_col}`").alias("src"), F.col(f"`{inlink_col}`").alias("dst")).dropna()
        degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
        weights = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(degree, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w"))
        weights = cut(weights.repartition("src"))
        vertices = cut(edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct())
        linked = cut(weights.select(F.col("dst").alias("v")).distinct())
        # Only linked vertices change; the others keep 1.
        still = vertices.join(linked, "v", "left_anti").select("v", F.lit(1.0).alias("r"))
        ranks = vertices.select("v", F.lit(1.0).alias("r"))
        for step in range(1, self.max_iters + 1):
            sums = weights.join(ranks, weights["src"] == ranks["v"]).groupBy("dst").agg(F.sum(F.col("r") * F.col("w")).alias("s"))
            ranks = sums.select(F.col("dst").alias("v"), (F.lit(1 - self.damping_factor) + F.lit(self.damping_factor) * F.col("s")).alias("r")).union(still)
            if step % cut_every == 0 or step == self.max_iters:
                ranks = cut(ranks)
        return Frame(ranks.select(F.col("v").alias("Vertex"), F.col("r").alias("Rank")).orderBy(F.desc("Rank"), "Vertex"))


def connected_components(nodes: DataFrame, links: DataFrame, max_iter: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links`` (a, b).

    Every node points to a smaller one or itself. In a step a node, and the node that it points to, turn to the smallest that a neighbour's
    target points to, and then to their target's target. So not only the border of a region moves but its root, and the steps grow
    with the logarithm of a path's length, not with the path. Labels still moving after ``max_iter`` steps are an error.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut(nodes.select("node", F.col("node").alias("component"), F.col("node").alias("up")))
    for _ in range(max_iter):
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("up").alias("c"))
        one = cut(label.join(seen, label["node"] == seen["a"], "left").select("node", "component", F.least("up", F.coalesce("c", "up")).alias("c")))
        hook = one.groupBy(F.col("component").alias("root")).agg(F.min("c").alias("h"))
        two = cut(one.join(hook, one["node"] == hook["root"], "left").select("node", F.least("component", "c", F.coalesce("h", "c")).alias("component"), F.col("component").alias("old")))
        if two.where("component < old").isEmpty():
            return two.select("node", "component")
        jump = two.select(F.col("node").alias("n2"), F.col("component").alias("up"))
        label = cut(two.join(jump, two["component"] == jump["n2"]).select("node", "component", "up"))
    raise RuntimeError(f"the components have not settled after {max_iter} steps")
