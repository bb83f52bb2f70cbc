"""K-means, DBSCAN and spatio-temporal DBSCAN."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np

from framewise.ml.base import Column, DataFrame, F, Frame, Model, emit, names, spark_df, x
from framewise.operators.geo import haversine
from framewise.operators.graph import connected_components
from framewise.operators.partition import with_position
from framewise.plans.scale import cut, free_name, split_code


class Kmeans(Model):
    """Lloyd's algorithm. Cost is the sum of distances (not squared); ends when it changes by less than ``epsilon``.

    Rows with a null don't take part in ``fit``. ``k-means||`` draws several candidates a round with a
    chance by their distance, at most 20 x ``n_clusters``, and weighs them on the driver (a few hundred points, whatever the data);
    ``random`` draws the rows of the smallest hashes. ``centroids`` fix the start instead. A step is one
    map-side aggregate by nearest centre.
    """

    parameters = ("feature_col", "centroids")

    def __init__(self, n_clusters: int = 3, max_iter: int = 100, epsilon: float = 1e-2, init_mode: str = "k-means||", centroids: Sequence[Sequence[float]] | None = None, seed: int = 7) -> None:
        if init_mode not in ("k-means||", "random"):
            raise ValueError("init_mode must be k-means|| or random")
        self.n_clusters, self.max_iter, self.epsilon, self.init_mode, self.seed = n_clusters, max_iter, epsilon, init_mode, seed
        self.start = [list(map(float, c)) for c in centroids] if centroids else None
        self.feature_col = self.centroids = self.cost = None

    @staticmethod
    def _squares(cols: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
        squares = [sum(((c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(cols, p)), F.lit(0.0)) for p in centres]
        return F.array(split_code(squares[0]), *squares[1:]) if len(centres) * len(cols) > 64 else F.array(*squares)

    def _draw(self, df: DataFrame, n: int) -> list[list[float]]:
        rows = df.distinct().orderBy(F.xxhash64(F.lit(self.seed), *df.columns)).limit(n).collect()
        return [[float(v) for v in r] for r in rows]

    def _parallel(self, df: DataFrame) -> list[list[float]]:
        cols = [F.col(c) for c in df.columns]
        centres = self._draw(df, 1)
        for step in range(5):
            d = df.withColumn("__fw_d", F.array_min(self._squares(cols, centres)))
            total = d.agg(F.sum("__fw_d")).first()[0]
            if not total:
                break
            chance = F.lit(2.0 * self.n_clusters / total) * F.col("__fw_d")
            drawn = F.pmod(F.xxhash64(F.lit(self.seed + 31 * (step + 1)), *cols), F.lit(1 << 30)) / float(1 << 30) < chance
            # About 2 x n_clusters are drawn; of many more, which takes an odd distribution, those of the smallest hashes are kept.
            found = d.where(drawn).select(*cols).distinct().orderBy(F.xxhash64(F.lit(self.seed), *cols), *cols).limit(20 * self.n_clusters).collect()
            centres += [[float(v) for v in r] for r in found]
        if len(centres) <= self.n_clusters:
            return (centres + [c for c in self._draw(df, 4 * self.n_clusters) if c not in centres])[: self.n_clusters]
        squares = self._squares(cols, centres)
        near = df.select((F.array_position(squares, F.array_min(squares)) - 1).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
        weight = np.zeros(len(centres))
        for r in near:
            weight[int(r["k"])] = r["n"]
        points, rng = np.array(centres), np.random.default_rng(self.seed)
        chosen = [points[weight.argmax()]]
        while len(chosen) < self.n_clusters:
            d = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0) * weight
            chosen.append(points[rng.choice(len(points), p=d / d.sum())] if d.sum() else points[len(chosen)])
        return [c.tolist() for c in chosen]

    def fit(self, data: Frame, feature_col: Sequence[str] | str):
        self.feature_col = names(feature_col)
        df = cut(spark_df(data).select(*[x(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.feature_col)]).dropna())
        cols = [F.col(c) for c in df.columns]
        centres = self.start or (self._parallel(df) if self.init_mode == "k-means||" else self._draw(df, self.n_clusters))
        before = math.inf
        for _ in range(self.max_iter):
            assigned = df.withColumn("__fw_s", self._squares(cols, centres)).withColumn("__fw_m", F.array_min("__fw_s")).withColumn("__fw_k", F.array_position("__fw_s", F.col("__fw_m")) - 1)
            rows = assigned.groupBy("__fw_k").agg(F.sum(F.sqrt("__fw_m")).alias("cost"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)]).collect()
            self.cost = sum(r["cost"] for r in rows)
            moved = [list(c) for c in centres]
            for r in rows:
                moved[int(r["__fw_k"])] = [r[f"a{i}"] for i in range(len(cols))]
            if abs(before - self.cost) < self.epsilon:
                break
            centres, before = moved, self.cost
        self.centroids = [list(c) for c in centres]
        return self

    def compute_cost(self) -> float:
        """Sum of the distances of the training rows to their centres."""
        self.check_fitted()
        return self.cost

    def transform(self, data: Frame, feature_col=None, pred_col: str = "prediction_kmeans") -> Frame:
        self.check_fitted()
        df = spark_df(data)
        cols = [x(c).cast("double") for c in names(feature_col or self.feature_col)]
        tmp = free_name("__fw_s", df.columns)
        work = df.withColumn(tmp, self._squares(cols, self.centroids))
        return emit(work, {pred_col: F.when(~F.exists(tmp, lambda v: v.isNull()), (F.array_position(tmp, F.array_min(tmp)) - 1).cast("int"))}, [tmp], True)


def _gaps(a: Sequence[tuple[Column, Column]], b: Sequence[tuple[Column, Column]]) -> list[Column]:
    """By measure, how far two boxes, given by their (least, greatest), are apart at least."""
    return [F.greatest(q[0] - p[1], p[0] - q[1], F.lit(0.0)) for p, q in zip(a, b)]


def _spans(a: Sequence[tuple[Column, Column]], b: Sequence[tuple[Column, Column]]) -> list[Column]:
    """By measure, how far rows of two boxes are apart at most."""
    return [F.greatest(q[1] - p[0], p[1] - q[0]) for p, q in zip(a, b)]


def _density_clusters(df: DataFrame, grid: Sequence[tuple[float, float]], near: Callable, within: Callable, maybe: Callable, measures: Mapping[str, Column], min_pts: int, pred: str) -> DataFrame:
    """DBSCAN on a grid whose cells are so small that all rows of one are within reach of each other.

    A row with at least ``min_pts`` rows within reach (itself included) is a core; cores within reach are
    connected; clusters are numbered from their smallest core; other rows within reach of a core join the cluster of the
    smallest number; the rest are noise, -1. Rows with a null, NaN or infinite measure are noise. Equal points are one point
    with a weight until the end.

    The rows of a cell that has ``min_pts`` of them are cores without a comparison, so only rows of thinner cells are compared with those of
    the cells around. The cores of a cell are in one cluster, so cells are the nodes that are connected: by their boxes or outermost
    cores; where these don't tell and the cells aren't connected by way of others, by their cores that are near the other's box.

    ``grid`` has by measure how far rows within reach are apart at most, and a cell's side (0: a cell a value). ``near`` compares two points;
    ``within`` and ``maybe`` tell from distances by measure whether all pairs, and whether any, can be within reach.
    """
    m = [f"__fw_m{i}" for i in range(len(measures))]
    work = df.withColumns(dict(zip(m, measures.values())))
    g = [f"__fw_g{i}" for i in range(len(m))]
    lo, hi = [f"__fw_lo{i}" for i in range(len(m))], [f"__fw_hi{i}" for i in range(len(m))]
    steps = list(itertools.product(*[(-1, 0, 1) if side else (0,) for _, side in grid]))
    at, fine, coarse = F.lit(True), [], []
    for c, (reach, side) in zip(m, grid):
        # Beyond 1e10 sides rounding could make a cell too wide: there every point is a cell.
        to = F.greatest(F.least(F.col(c) / side, F.lit(1e14)), F.lit(-1e14)) if side else F.col(c)
        at = at & (F.abs(to) < 1e10) if side else at
        fine.append(F.floor(to) if side else to)
        coarse.append(F.floor(F.floor(to) / float(math.ceil(reach / side))) if side else to)
    ok = F.lit(True)
    for c in m:
        ok = ok & (F.abs(F.col(c)) < math.inf)
    points = work.where(ok).groupBy(*m).agg(F.count(F.lit(1)).alias("w"))
    points = cut(points.select(*m, "w", F.xxhash64(*m).alias("node"), F.when(at, F.xxhash64(*fine)).otherwise(F.xxhash64(F.lit("point"), *m)).alias("cell"), *[c.alias(n) for c, n in zip(coarse, g)]))

    def point(prefix: str = "") -> list[Column]:
        return [F.col(prefix + c) for c in m]

    def dot(prefix: str = "") -> list[tuple[Column, Column]]:
        return [(c, c) for c in point(prefix)]

    def box(prefix: str) -> list[tuple[Column, Column]]:
        return [(F.col(prefix + a), F.col(prefix + b)) for a, b in zip(lo, hi)]

    def boxes(rows: DataFrame, **more: Column) -> DataFrame:
        ends = [f(c).alias(n) for f, to in ((F.min, lo), (F.max, hi)) for c, n in zip(m, to)]
        return cut(rows.groupBy("cell", *g).agg(*ends, *[c.alias(n) for n, c in more.items()]))

    def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])

    def around(some: DataFrame, other: DataFrame) -> DataFrame:
        """Cells a_ with the cells b_ that may have rows within reach."""
        moved = F.explode(F.array(*[F.struct(*[(F.col(f"a_{c}") + o if o else F.col(f"a_{c}")).alias(f"b_{c}") for c, o in zip(g, step)]) for step in steps]))
        spread = prefixed(some, "a_").withColumn("s", moved).select("*", "s.*").drop("s")
        return spread.join(prefixed(other, "b_"), [f"b_{c}" for c in g]).where(maybe(_gaps(box("a_"), box("b_"))))

    cells = boxes(points, w=F.sum("w"))
    thin = points.join(cells.where(F.col("w") < min_pts).select("cell"), "cell", "left_semi").select("cell", "node", *m)
    beside = cut(around(cells.where(F.col("w") < min_pts), cells).select(F.col("a_cell").alias("cell"), "b_cell", "b_w", *[f"b_{c}" for c in (*lo, *hi)]))
    met = cut(thin.join(beside, "cell").where(maybe(_gaps(dot(), box("b_")))).select("node", *m, "b_cell", "b_w", within(_spans(dot(), box("b_"))).alias("all")))
    one = met.where(~F.col("all")).select("node", *m, "b_cell").join(prefixed(points.select("cell", "w", *m), "b_"), "b_cell").where(near(point(), point("b_"))).groupBy("node").agg(F.sum("b_w").alias("n"))
    many = met.where("all").groupBy("node").agg(F.sum("b_w").alias("n"))
    core = one.union(many).groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pts).select("node")
    dense = points.join(cells.where(F.col("w") >= min_pts).select("cell"), "cell", "left_semi")
    cores = cut(dense.select("cell", "node", *m, *g).union(points.join(core, "node", "left_semi").select("cell", "node", *m, *g)))

    p = F.struct(*m)
    tips = F.array(*[f(p, c) for c in m for f in (F.min_by, F.max_by)])
    held = boxes(cores, first=F.min(p), tips=tips)
    touch = F.exists("a_tips", lambda u: F.exists("b_tips", lambda v: near([u[c] for c in m], [v[c] for c in m])))
    pairs = cut(around(held, held).where("a_cell < b_cell").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), (within(_spans(box("a_"), box("b_"))) | touch).alias("linked")))
    label = connected_components(held.select(F.col("cell").alias("node")), pairs.where("linked").select("a", "b"))
    ends = [label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("a", "b")]
    unsure = cut(pairs.where(~F.col("linked")).select("a", "b").join(ends[0], "a").join(ends[1], "b").where("a_in <> b_in"))
    if not unsure.isEmpty():

        def facing(c: str, to: str) -> DataFrame:
            other = held.select(F.col("cell").alias(to), *lo, *hi)
            here = unsure.select("a", "b").join(other, to).join(cores.select(F.col("cell").alias(c), *m), c)
            return here.where(maybe(_gaps(dot(), box("")))).select("a", "b", *[F.col(x).alias(f"{c}_{x}") for x in m])

        linked = facing("a", "b").join(facing("b", "a"), ["a", "b"]).where(near(point("a_"), point("b_"))).select("a", "b").distinct()
        joined = connected_components(label.select(F.col("component").alias("node")).distinct(), linked.join(unsure, ["a", "b"]).select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
        label = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component").select("node", F.col("whole").alias("component"))

    label = cut(held.join(label.withColumnRenamed("node", "cell"), "cell").select("cell", "component", "first", *lo, *hi))
    order = cut(label.groupBy("component").agg(F.min("first").alias("first")).orderBy("first"))
    label = cut(label.join(with_position(order, "k").select("component", "k"), "component").select(F.col("cell").alias("b_cell"), "k", *lo, *hi))
    rest = met.join(cores.select("node"), "node", "left_anti").select("node", *m, "b_cell").join(label, "b_cell")
    rest = cut(rest.where(maybe(_gaps(dot(), box("")))).select("node", *m, "b_cell", "k", within(_spans(dot(), box(""))).alias("all")))
    beyond = rest.where(~F.col("all")).join(prefixed(cores.select("cell", *m), "b_"), "b_cell").where(near(point(), point("b_")))
    border = rest.where("all").select(*m, "k").union(beyond.select(*m, "k")).groupBy(*m).agg(F.min("k").alias("k"))
    named = border.union(cores.withColumnRenamed("cell", "b_cell").join(label, "b_cell").select(*m, "k"))
    out = work.join(named, m, "left")
    return out.select(*[x(c) for c in df.columns if c != pred], F.coalesce("k", F.lit(-1)).cast("int").alias(pred))


class DBSCAN(Model):
    """Density clusters of numeric features: ``eps`` reach (Euclid), ``min_pts`` rows make a core; noise is -1."""

    def __init__(self, feature_col: Sequence[str] | str, pred_col: str = "prediction_DBSCAN", eps: float = 0.1, min_pts: int = 15) -> None:
        self.feature_col, self.pred_col, self.eps, self.min_pts = names(feature_col), pred_col or "prediction_DBSCAN", eps, min_pts

    def fit_predict(self, data: Frame) -> Frame:
        df = spark_df(data)
        eps = abs(float(self.eps))
        grid = [(eps * (1 + 1e-9), eps / math.sqrt(len(self.feature_col)) * (1 - 1e-5))] * len(self.feature_col)

        def within(far: Sequence[Column]) -> Column:
            return sum((F.pow(c, 2) for c in far), F.lit(0.0)) <= self.eps**2

        def near(a: Sequence[Column], b: Sequence[Column]) -> Column:
            return within([p - q for p, q in zip(a, b)])

        measures = {c: x(c).cast("double") + F.lit(0.0) for c in self.feature_col}
        return Frame(_density_clusters(df, grid, near, within, within, measures, self.min_pts, self.pred_col))

    def fit(self, data, *_):
        return self

    def transform(self, data: Frame) -> Frame:
        return self.fit_predict(data)


class STDBSCAN:
    """Clusters of events near in space (metres) and time (minutes)."""

    def __init__(self, lat_col: str, lon_col: str, datetime: str, spatial_threshold: float = 1000, temporal_threshold: float = 60, min_pts: int = 15, pred_col: str = "cluster") -> None:
        self.lat_col, self.lon_col, self.datetime, self.min_pts, self.pred_col = lat_col, lon_col, datetime, min_pts, pred_col
        self.spatial_threshold, self.temporal_threshold = spatial_threshold, temporal_threshold

    def fit_predict(self, data: Frame) -> Frame:
        df = spark_df(data)
        lat = F.abs(x(self.lat_col).cast("double"))
        row = df.agg(F.max(F.when(lat < math.inf, lat))).first()
        top = min(float(row[0] or 0.0) + 1e-9, 89.9)
        step_lat = math.degrees(self.spatial_threshold / 6_371_000.0) * 1.0001
        step_lon = step_lat / math.cos(math.radians(min(top + step_lat, 89.9)))
        seconds = self.temporal_threshold * 60.0
        degrees = math.degrees(self.spatial_threshold / 6_371_000.0)
        side = degrees / math.sqrt(2) * (1 - 1e-5)  # a degree of longitude is nowhere longer than one of latitude
        grid = [(step_lat, side), (step_lon, side), (seconds, seconds * (1 - 1e-5))]

        def near(a: Sequence[Column], b: Sequence[Column]) -> Column:
            return (F.abs(a[2] - b[2]) <= seconds) & (haversine(a[0], a[1], b[0], b[1]) <= self.spatial_threshold)

        def within(far: Sequence[Column]) -> Column:
            return (far[2] <= seconds) & (F.hypot(far[0], far[1]) <= degrees * (1 - 1e-6))

        def maybe(far: Sequence[Column]) -> Column:
            return (far[0] <= step_lat) & (far[1] <= step_lon) & (far[2] <= seconds)

        measures = {"lat": x(self.lat_col).cast("double"), "lon": x(self.lon_col).cast("double"), "t": F.unix_micros(x(self.datetime).cast("timestamp")) / 1e6}
        return Frame(_density_clusters(df, grid, near, within, maybe, measures, self.min_pts, self.pred_col))


def st_dbscan(data: Frame, settings: Mapping[str, object]) -> Frame:
    """``STDBSCAN`` with settings ``lat_col, lon_col, datetime`` and optionally ``spatial_threshold, temporal_threshold, minPts, predCol``."""
    if not all(k in settings for k in ("lat_col", "lon_col", "datetime")):
        raise ValueError("lat_col, lon_col and datetime are needed")
    s = dict(settings)
    return STDBSCAN(s["lat_col"], s["lon_col"], s["datetime"], s.get("spatial_threshold", 1000), s.get("temporal_threshold", 60), s.get("minPts", 15), s.get("predCol", "cluster")).fit_predict(data)
