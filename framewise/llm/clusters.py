"""Grouping records into similarity clusters: Markov clustering of a graph of record cells, contracted until nothing merges."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.graph import connected_components
from framewise.plans.scale import cut, join_small


@dataclass
class Clusters:
    """``members``: (id, cluster_key). ``summary``: cluster_key, size, the means and the most typical records."""

    members: DataFrame
    summary: DataFrame


def markov_cluster(edges: DataFrame, inflation: float = 1.4, prune: float = 0.01, max_iter: int = 80, tol: float = 1e-3) -> DataFrame:
    """Markov clustering of a weighted graph: (node, attractor, flow).

    ``edges`` are (i, j, w): the similarity of node j to node i, w > 0, loops included, long ids. The
    columns of the matrix are made stochastic; then it is squared by a join on the inner index with a sum, entries under
    ``prune`` are dropped (never a column's largest), the rest are raised to ``inflation`` and made stochastic
    again, until every column is nearly one entry. Pruning bounds a column to 1 / ``prune``
    entries, so a squaring has at most nodes / prune^2 products. In the limit the rows with entries are the
    attractors, and the connected parts of the matrix the clusters (several attractors that share columns are one
    cluster). ``flow`` is a node's row sum, ``attractor`` the node of a cluster's largest (ties: the smallest id).
    A flow that has not settled after ``max_iter`` squarings is an error, no result.
    """
    column = Window.partitionBy("j")

    def stochastic(m: DataFrame) -> DataFrame:
        return m.withColumn("p", F.col("w") / F.sum("w").over(column)).select("i", "j", "p")

    m = cut(stochastic(edges.select("i", "j", "w").where("w > 0")))
    for _ in range(max_iter):
        left = m.select(F.col("i"), F.col("j").alias("k"), F.col("p").alias("a"))
        right = m.select(F.col("i").alias("k"), F.col("j"), F.col("p").alias("b"))
        # One exchange by column serves the sum, the pruning and the scaling.
        square = left.join(right.hint("merge"), "k").repartition("j").groupBy("j", "i").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
        kept = square.withColumn("top", F.max("p").over(column)).where((F.col("p") >= prune) | (F.col("p") == F.col("top")))
        m = cut(stochastic(kept.select("i", "j", F.pow("p", F.lit(float(inflation))).alias("w"))))
        chaos = m.groupBy("j").agg((F.max("p") - F.sum(F.col("p") * F.col("p"))).alias("c")).agg(F.max("c")).first()[0]
        if chaos is None or chaos < tol:
            break
    else:
        raise RuntimeError(f"the flow has not settled after {max_iter} squarings")
    flow = m.groupBy(F.col("i").alias("node")).agg(F.sum("p").alias("flow"))
    # A column belongs to its largest row; rows that share a column are one cluster.
    own = m.groupBy("j").agg(F.max_by("i", F.struct("p", -F.col("i"))).alias("to"), F.count(F.lit(1)).alias("n"))
    shared = m.join(own.where("n > 1").select("j", "to"), "j").where("i <> to").select(F.col("i").alias("a"), F.col("to").alias("b")).distinct()
    parts = connected_components(flow.select("node"), shared)
    rows = cut(parts.join(flow, "node"))
    strongest = rows.groupBy("component").agg(F.max_by("node", F.struct(F.round("flow", 9), -F.col("node"))).alias("attractor"))
    heads = rows.join(strongest, "component").select(F.col("node").alias("to"), "attractor")
    found = own.select(F.col("j").alias("node"), "to").join(heads, "to").join(flow, "node", "left")
    return found.select("node", "attractor", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def contracted_clusters(flows: DataFrame, inflation: float = 1.4, prune: float = 0.01) -> DataFrame:
    """Markov clustering level by level: (node, component, flow).

    ``flows`` are (i, j, f): what moves from node j to node i in a step, loops included. Wide clusters come out of one
    Markov clustering in several parts. Each level makes the last one's clusters its nodes, sums the flows
    between them and clusters again, until none merge: parts between which much of the flow passes join, parts behind a thin bridge don't.
    ``flow`` is that of the first level.
    """
    flow = None
    state = cut(flows.select(F.col("j").alias("node"), F.col("j").alias("component")).distinct())
    graph = flows
    while True:
        found = cut(markov_cluster(graph.select("i", "j", F.col("f").alias("w")), inflation, prune))
        flow = found.select("node", "flow") if flow is None else flow
        before, after = found.count(), found.select("attractor").distinct().count()
        state = cut(state.join(found.select(F.col("node").alias("component"), "attractor"), "component").select("node", F.col("attractor").alias("component")))
        if after == before:
            break
        to = lambda c, alias: state.select(F.col("node").alias(c), F.col("component").alias(alias))
        graph = cut(flows.join(to("i", "a"), "i").join(to("j", "b"), "j").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("f").alias("f")))
        if graph.where("i <> j").isEmpty():
            break
    return state.join(flow, "node").select("node", "component", "flow")


def _width(low: float, high: float, n: int, d: int, factor: float, most: int) -> float:
    """Cell width of a measure, to three digits so that it doesn't hang on the last bits of a sketched percentile."""
    span = high - low
    if not span > 0:
        return 1.0
    return float(f"{span * max(factor * n ** (-1 / (d + 2)), 1 / most):.3g}")


def similarity_clusters(df: DataFrame, record_id: str, measures: Sequence[str], factor: float = 0.45, most_cells: int = 64, least: int = 8, inflation: float = 1.4, prune: float = 0.01) -> Clusters:
    """Clusters of records alike in all ``measures``, with emptier space around them.

    Records with a null, NaN or infinite measure and those outside dense space belong to none. Equal
    records fall together, an empty table gives empty results, other columns are ignored. Rescaling a measure
    changes nothing.

    1. Every record falls into a cell of a grid and a cell of the grid shifted by half a width. Widths are ``factor`` x
       the 1 % to 99 % span of a measure x n^(-1/(d+2)), the rate of multivariate histograms, but at most ``most_cells``
       to a span. Pairs of cells with their counts are one map-side aggregate; from here on the work
       grows with the occupied pairs, not the records (nor with 3^d neighbours).
    2. The nodes stand for the records of a cell. A node's density is the mean number of records in the shifted cells of
       its records. Nodes are core from ``least`` records and eight standard deviations over the background
       (lower quartile of coarse cells); other nodes over the background that share a shifted cell with a core one are in as well.
    3. Flow from node j to node i: a record of j goes to a random record of its shifted cell. ``contracted_clusters``
       runs Markov clustering on it, and its clusters are the result. Those under ``least`` records are given up.
       ``cluster_key`` is the smallest id of a cluster.

    The most typical records are those nearest the centres of the cluster's (up to three) nodes of strongest flow.
    """
    d = len(measures)
    a, s = [f"a{i}" for i in range(d)], [f"s{i}" for i in range(d)]
    x = [F.col(f"`{c}`").cast("double") for c in measures]
    ok = reduce(lambda p, q: p & q, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15) for c in x])
    points = df.where(ok).select(F.col(f"`{record_id}`").alias("id"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    row = points.agg(F.count(F.lit(1)), *[F.percentile_approx(f"x{i}", [0.01, 0.99], 10_000) for i in range(d)]).first()
    widths = [_width(*(row[i + 1] or (0.0, 0.0)), max(row[0], 1), d, factor, most_cells) for i in range(d)]

    def cell(i: int, shift: float) -> Column:
        return F.floor(F.round(F.col(f"x{i}") / F.lit(widths[i]), 6) + F.lit(shift)).cast("long")

    placed = points.withColumns({c: cell(i, 0.0) for i, c in enumerate(a)})
    both = placed.withColumns({c: cell(i, 0.5) for i, c in enumerate(s)})
    pairs = both.groupBy(*a, *s).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), *[F.sum(f"x{i}").alias(f"t{i}") for i in range(d)])
    pairs = cut(pairs.select(F.xxhash64(*a).alias("node"), F.xxhash64(*s).alias("place"), "*"))

    coarse = pairs.groupBy(*[F.floor(F.col(c) / 4).alias(c) for c in a]).agg(F.sum("n").alias("n")).agg(F.percentile_approx("n", 0.25, 10_000)).first()[0]
    base = float(coarse or 0) / 4**d
    over = base + 8 * math.sqrt(base)
    places = pairs.groupBy("place").agg(F.sum("n").alias("m"))
    known = pairs.select("node", "place", "n").join(places, "place")
    dense = cut(known.groupBy("node").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("density")))
    core = F.col("density") >= max(float(least), over)
    # Shifted cells that core nodes reach; whoever shares one and is over the background is in.
    open_places = known.join(dense.where(core).select("node"), "node", "left_semi").select("place").distinct()
    beside = pairs.select("node", "place").join(open_places, "place", "left_semi").select("node").distinct()
    inside = dense.where(F.col("density") >= over + 1).join(beside, "node", "left_semi")
    part = cut(pairs.join(inside.select("node"), "node", "left_semi").select("node", "place", "n"))
    share = part.join(part.groupBy("place").agg(F.sum("n").alias("m")), "place")
    flows = share.select(F.col("node").alias("i"), "place", (F.col("n") / F.col("m")).alias("q")).join(part.select(F.col("node").alias("j"), "place", "n"), "place")
    flows = cut(flows.groupBy("i", "j").agg(F.sum(F.col("q") * F.col("n")).alias("f")))

    found = cut(contracted_clusters(flows, inflation, prune))
    sums = [F.sum(f"t{i}").alias(f"t{i}") for i in range(d)]
    space = cut(pairs.groupBy("node", *a).agg(F.sum("n").alias("n"), F.min("least_id").alias("least_id"), *sums).join(found, "node"))
    totals = space.groupBy("component").agg(F.sum("n").alias("size"), F.min("least_id").alias("cluster_key"), *[(F.sum(f"t{i}") / F.sum("n")).alias(f"mean_{m}") for i, m in enumerate(measures)])
    totals = cut(totals.where(F.col("size") >= least))
    cells_of = cut(space.join(totals.select("component", "cluster_key"), "component").select(*a, "cluster_key"))
    members = join_small(placed.select("id", *a), cells_of, a, "inner").select(F.col("id").alias(record_id), "cluster_key")

    strongest = space.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("flow"), F.desc("n"), *a))).where("rank <= 3")  # nodes, not records
    centres = cut(strongest.select("component", "rank", *a, *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(d)]))
    away = reduce(lambda p, q: p + q, [F.pow((F.col(f"x{i}") - F.col(f"m{i}")) / F.lit(widths[i]), F.lit(2.0)) for i in range(d)])
    typical = join_small(placed, centres, a, "inner").groupBy("component", "rank").agg(F.min_by("id", F.struct(away, F.col("id"))).alias("id"))
    typical = typical.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("typical"))  # three a cluster
    summary = totals.join(typical, "component", "left").select("cluster_key", "size", *[f"mean_{m}" for m in measures], "typical")
    return Clusters(members, summary)
