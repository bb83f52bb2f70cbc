"""Statistics, models and evaluators against known values."""

import math

import numpy as np
import pandas as pd
import pytest

from framewise.frame import Frame
from framewise.ml.clustering import DBSCAN, Kmeans, st_dbscan
from framewise.ml.evaluation import BinaryClassificationMetrics, MultilabelMetrics, RegressionMetrics
from framewise.ml.feature import PCA, Binarizer, MaxAbsScaler, MinMaxScaler, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer
from framewise.ml.fpm import AssociationRules, FPGrowth
from framewise.ml.supervised import SVM, GDRegressor, KNearestNeighbors, LogisticRegression, OrdinaryLeastSquares
from framewise.operators.geo import crst_transform
from framewise.operators.graph import PageRank, connected_components


def frame(ctx, data, columns, parts=2):
    return ctx.parallelize(pd.DataFrame(data, columns=columns), parts)


def test_statistics(ctx):
    f = frame(ctx, {"a": [1, 2, 3, 4, 5, 6], "b": [3, 1, 4, 1, 5, 9], "c": ["x", "y", None, "x", "x", "z"]}, None)
    a, b = np.arange(1, 7), np.array([3, 1, 4, 1, 5, 9])
    assert f.correlation("a", "b") == round(np.corrcoef(a, b)[0, 1], 5)
    assert f.covariance("a", "b") == round(np.cov(a, b)[0, 1], 5)
    d = f.describe().set_index("column")
    assert d.at["a", "mean"] == 3.5 and d.at["c", "nan_count"] == 1 and d.at["c", "max"] == "z" and d.at["a", "count"] == 6
    t = f.cross_tab("c", "b").sort("key").to_df()
    assert t["key"].tolist() == ["x", "y", "z"] and t["1"].tolist() == [1, 1, 0]
    assert "c_freqItems" in f.freq_items("c", 0.4).columns()
    assert math.isnan(frame(ctx, {"a": [1, 1], "b": [1, 2]}, None).correlation("a", "b"))
    with pytest.raises(ValueError):
        frame(ctx, {"a": [1], "b": [1]}, None, 1).covariance("a", "b")


def test_kolmogorov_smirnov_gamma(ctx):
    np.random.seed(123)
    f = frame(ctx, {"d": np.random.gamma(15.5, 1 / 7.0, 100)}, None, 4)
    d, p = f.kolmogorov_smirnov_one_sample("d", "gamma", args=(15.5, 0, 1 / 7.0))
    assert 0 < d < 0.2 and 0.05 < p <= 1
    assert f.kolmogorov_smirnov_one_sample("d", "norm", args=(0, 1))[1] < 1e-6


def test_scalers(ctx):
    f = frame(ctx, [[1.0, -1, 2], [2, 0, 0], [0, 1, -1]], ["x", "y", "z"])
    assert MaxAbsScaler().fit_transform(f, ["x", "y", "z"]).to_df().values.tolist() == [[0.5, -1, 1], [1, 0, 0], [0, 1, -0.5]]
    assert Binarizer().transform(f, ["x", "y", "z"], remove=True).to_df().values.tolist() == [[1, 0, 1], [1, 0, 0], [0, 1, 0]]
    g = frame(ctx, [[-1.0, 2], [-0.5, 6], [0, 10], [1, 18]], ["x", "y"])
    assert MinMaxScaler().fit_transform(g, ["x", "y"]).to_df().values.tolist() == [[0, 0], [0.25, 0.25], [0.5, 0.5], [1, 1]]
    h = frame(ctx, [[0, 0], [0, 0], [1, 1], [1, 1]], ["x", "y"])
    assert StandardScaler().fit_transform(h, ["x", "y"]).to_df().values.tolist() == [[-1, -1], [-1, -1], [1, 1], [1, 1]]


def test_encoders(ctx, tmp_path):
    f = frame(ctx, [["Male", 1], ["Female", 3], ["Female", 2]], ["x", "y"])
    assert OneHotEncoder().fit_transform(f, ["x", "y"], remove=True).to_df().values.tolist() == [[0, 1, 1, 0, 0], [1, 0, 0, 0, 1], [1, 0, 0, 1, 0]]
    g = frame(ctx, [[0.0, 1], [2, 3], [4, 5]], ["x", "y"])
    assert PolynomialExpansion().transform(g, ["x", "y"], remove=True).to_df().values.tolist() == [[1, 0, 1, 0, 0, 1], [1, 2, 3, 4, 6, 9], [1, 4, 5, 16, 20, 25]]
    m = StringIndexer().fit(f, "x").save_model(f"{tmp_path}/m")
    assert StringIndexer().load_model(f"{tmp_path}/m").transform(f, output_col="k").to_df()["k"].tolist() == [1, 0, 0]
    assert m.mapping == ["Female", "Male"]


def test_pca(ctx):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]])
    m = PCA(2).fit(frame(ctx, x, ["a", "b", "c"]), ["a", "b", "c"])
    assert np.allclose(m.eig_values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    got = m.transform(frame(ctx, x, ["a", "b", "c"], 1), remove=True).to_df().to_numpy()
    assert np.allclose(np.abs(got[:, 0]), np.abs(x @ np.array(m.eig_vectors)[:, 0]))


def test_itemsets_and_rules(ctx, spark):
    f = Frame(spark.createDataFrame([([1, 2, 5],), ([1, 2, 3, 5],), ([1, 2],)], "col_0 array<int>"))
    out = FPGrowth(0.5).fit_transform(f, "col_0")
    assert sorted((tuple(r["items"]), r["support"]) for r in out.df.collect()) == [((1,), 3), ((1, 2), 3), ((1, 2, 5), 2), ((1, 5), 2), ((2,), 3), ((2, 5), 2), ((5,), 2)]
    rules = AssociationRules(0.9).fit_transform(out).df.collect()
    assert {(tuple(r[0]), tuple(r[1])) for r in rules} >= {((5,), (1,)), ((5,), (2,)), ((1,), (2,)), ((1, 5), (2,))}
    assert all(r["confidence"] >= 0.9 for r in rules)


def test_evaluators(ctx):
    f = frame(ctx, {"l": [1, 1, 1, 0, 0, 0, 0], "p": [1, 0, 1, 1, 0, 0, 0]}, None)
    m = BinaryClassificationMetrics("l", "p", f)
    assert (m.precision, m.recall, m.accuracy) == (2 / 3, 2 / 3, 5 / 7)
    assert MultilabelMetrics("l", "p", f).precision_recall["Recall"].tolist() == [0.75, 2 / 3]
    y, p = [1.0, 2, 3, 4, 5, 6, 7.5], [1.1, 1.9, 3.2, 3.7, 5.1, 6.2, 7.0]
    r = RegressionMetrics(["x"], "y", "p", frame(ctx, {"x": y, "y": y, "p": p}, None))
    e = np.array(y) - np.array(p)
    assert np.isclose(r.mse, (e**2).sum() / 5) and np.isclose(r.mae, np.abs(e).sum() / 5)
    y, p = np.array(y, float), np.array(p, float)
    assert np.isclose(r.msr, ((y - y.mean()) ** 2).sum() - ((y - p) ** 2).sum())


def test_supervised(ctx):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(-2, 0.5, (60, 2)), rng.normal(2, 0.5, (60, 2))])
    y = [0] * 60 + [1] * 60
    f = frame(ctx, {"a": x[:, 0], "b": x[:, 1], "y": y, "s": [2 * v - 1 for v in y]}, None, 3)
    assert (LogisticRegression(alpha=1.0, max_iter=15).fit_transform(f, ["a", "b"], "y").to_df().eval("y == prediction_LogReg")).mean() > 0.98
    assert (SVM(coef_lr=0.5, max_iter=15).fit_transform(f, ["a", "b"], "s").to_df().eval("s == prediction_SVM")).mean() > 0.98
    assert (KNearestNeighbors(3).fit_transform(f, ["a", "b"], "y").to_df().eval("y == prediction_kNN")).all()
    k = KNearestNeighbors(5).fit(f, ["a", "b"], "y")
    k.block = 13
    assert (k.transform(f).to_df().eval("y == prediction_kNN")).all()
    g = frame(ctx, {"a": [1.0, 2, 3, None], "y": [3.0, 5, 7, 1]}, None)
    m = OrdinaryLeastSquares().fit(g, "a", "y")
    assert np.isclose(m.b1, 2) and np.isclose(m.b0, 1)
    d = GDRegressor(max_iter=5000, alpha=0.5, tol=1e-9).fit(g, "a", "y")
    assert np.allclose(d.theta, [1, 2], atol=0.05)


def test_clustering(ctx):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    f = frame(ctx, x, ["a", "b"], 3)
    for mode in ("k-means||", "random"):
        out = Kmeans(3, init_mode=mode, seed=2).fit_transform(f, ["a", "b"])
        assert out.df.groupBy("prediction_kmeans").count().count() <= 3
    m = Kmeans(3, centroids=[[0, 1], [4, 4], [0, 4]]).fit(f, ["a", "b"])
    assert sorted(round(c[0]) for c in m.centroids) == [0, 0, 5] and m.compute_cost() < 30
    noisy = frame(ctx, np.vstack([x, [[20, 20]]]), ["a", "b"], 3)
    out = DBSCAN(["a", "b"], "k", eps=0.5, min_pts=5).fit_predict(noisy).to_df()
    assert sorted(out["k"].value_counts().to_dict().items()) == [(-1, 1), (0, 40), (1, 40), (2, 40)]


def test_st_dbscan(ctx):
    t = pd.Timestamp("2020-01-01")
    near = [(10.0 + i * 1e-4, 20.0, t + pd.Timedelta(minutes=i)) for i in range(10)]
    late = [(10.0 + i * 1e-4, 20.0, t + pd.Timedelta(hours=9, minutes=i)) for i in range(10)]
    f = frame(ctx, [*near, *late, (11.0, 20.0, t)], ["lat", "lon", "at"])
    out = st_dbscan(f, {"lat_col": "lat", "lon_col": "lon", "datetime": "at", "spatial_threshold": 50, "temporal_threshold": 5, "minPts": 3}).to_df()
    assert sorted(out["cluster"].value_counts().to_dict().items()) == [(-1, 1), (0, 10), (1, 10)]


def by_pairs(points, reach, min_pts):
    """DBSCAN over the matrix of ``reach``: clusters are numbered from their smallest core, shared borders go to the smallest number."""
    core, out, k = reach.sum(axis=1) >= min_pts, np.full(len(points), -1), 0
    for i in sorted(np.flatnonzero(core), key=lambda i: tuple(points[i])):
        if out[i] < 0:
            todo, out[i] = [i], k
            while todo:
                new = np.flatnonzero(reach[todo.pop()] & core & (out < 0))
                out[new] = k
                todo += list(new)
            k += 1
    for i in np.flatnonzero(~core):
        out[i] = min(out[reach[i] & core], default=-1)
    return out


def test_dbscan_of_a_long_chain(ctx):
    """One cluster, 4,000 steps from end to end."""
    f = frame(ctx, [(float(i),) for i in range(4000)], ["a"], 3)
    assert DBSCAN(["a"], "k", eps=1.0, min_pts=2).fit_predict(f).df.groupBy("k").count().collect() == [(0, 4000)]


def test_dbscan_against_all_pairs(ctx):
    rng = np.random.default_rng(5)
    shared = np.array([[100 + 10 * i + d, 0] for i in range(8) for d in (0, 0.1, 0.2, 1.1, 2.0, 2.1, 2.2)])  # 1.1 is a border of both sides
    facing = np.vstack([rng.uniform([50, 0], [50.5, 6], (150, 2)), rng.uniform([51.48, 0], [52, 6], (150, 2)), rng.uniform([53.1, 0], [53.5, 6], (100, 2))])
    flat = np.vstack([shared, facing, rng.normal(0, 0.05, (200, 2)), rng.uniform(-8, 8, (300, 2)), [[3e11, 0], [3e11, 0.5], [3e11, 1], [3e11, 1.5]], np.repeat([[30, 30], [30.5, 30]], 3, axis=0)])
    for points in (flat, rng.uniform(0, 6, (400, 3)), np.round(rng.uniform(0, 300, (300, 1)))):
        reach = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= 1
        names = list("abc")[: points.shape[1]]
        rows = [(i, *map(float, p)) for i, p in enumerate(points)]
        odd = [(len(rows) + i, *[v] * len(names)) for i, v in enumerate([None, None, None, None, *[math.nan] * 4, *[math.inf] * 4])]
        out = DBSCAN(names, "k", eps=1.0, min_pts=4).fit_predict(frame(ctx, rows + odd, ["i", *names], 3)).df.select("i", "k").collect()
        found = [k for _, k in sorted(map(tuple, out))]
        assert found == [*by_pairs(points, reach, 4), *[-1] * len(odd)]


def test_st_dbscan_against_all_pairs(ctx):
    rng = np.random.default_rng(6)
    t = pd.Timestamp("2020-01-01")
    points = np.vstack([np.column_stack([rng.uniform(lat, lat + 0.05, 150), rng.uniform(-49, -48.9, 150), rng.integers(0, 60, 150)]) for lat in (-25.4, 60.0)])
    lat, lon = np.radians(points[:, 0]), np.radians(points[:, 1])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    reach = (2 * 6_371_000 * np.arcsin(np.sqrt(h)) <= 900) & (abs(points[:, 2][:, None] - points[:, 2]) <= 15)
    f = frame(ctx, [(i, float(a), float(b), t + pd.Timedelta(minutes=int(m))) for i, (a, b, m) in enumerate(points)], ["i", "lat", "lon", "at"], 3)
    out = st_dbscan(f, {"lat_col": "lat", "lon_col": "lon", "datetime": "at", "spatial_threshold": 900, "temporal_threshold": 15, "minPts": 4}).df
    assert [k for _, k in sorted(map(tuple, out.select("i", "cluster").collect()))] == list(by_pairs(points, reach, 4))


def test_graph(ctx, spark):
    r = PageRank(0.85, 30).transform(frame(ctx, [(1, 2), (2, 3), (3, 1), (4, 1)], ["s", "d"]), "s", "d").to_df().set_index("Vertex")["Rank"]
    assert r[4] == 1.0 and np.isclose(r[1], 0.15 + 0.85 * (r[3] + 1.0), rtol=0.05)
    nodes = spark.range(20).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(12, 15)], "a long, b long")
    found = dict(connected_components(nodes, links).collect())
    assert all(found[i] == 0 for i in range(10)) and found[15] == 12 and found[11] == 11


def test_reprojection(spark):
    df = spark.createDataFrame([(48.8566, 2.3522)], "lat double, lon double")
    e = crst_transform(df, "lat", "lon", 4326, 32631).first()
    assert abs(e["lon"] - 452_484) < 2 and abs(e["lat"] - 5_411_718) < 2
    back = crst_transform(crst_transform(df, "lat", "lon", 4326, 32631), "lat", "lon", 32631, 4326).first()
    assert abs(back["lat"] - 48.8566) < 1e-8 and abs(back["lon"] - 2.3522) < 1e-8


def test_embeddings_by_all_dimensions_and_rows(spark):
    from framewise.queries.catalogue import queries

    d = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding").collect())
    e, labels = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    far = ((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert {r["vec_id"]: r["p"] for r in queries()["knn"](spark, d).collect()} == {r["vec_id"]: labels[i] for r, i in zip(rows, far.argmin(axis=1))}
    kinds = np.unique(labels)
    means, spread = (np.array([f(e[labels == k], axis=0) for k in kinds]) for f in (np.mean, np.var))
    spread += 1e-9 * spread.max()
    scores = -0.5 * (np.log(2 * np.pi * spread)[None] + (e[:, None, :] - means[None]) ** 2 / spread[None]).sum(axis=2)
    assert {r["vec_id"]: r["p"] for r in queries()["gaussian_nb"](spark, d).collect()} == {r["vec_id"]: kinds[i] for r, i in zip(rows, scores.argmax(axis=1))}


def test_bayes_refuses_too_many_classes(spark):
    from framewise.frame import Frame
    from framewise.ml.supervised import GaussianNB

    with pytest.raises(ValueError):
        GaussianNB().fit(Frame(spark.range(10_001).selectExpr("id AS y", "double(id) AS a")), ["a"], "y")


def test_knn_in_blocks_is_knn(ctx):
    """More training rows than one block: dealt into pairs of blocks and parts, with repeated points, a gap and own ids left out."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 2)), 2)
    x[:20] = x[20:40]
    data = pd.DataFrame({"id": range(240), "a": x[:, 0], "b": x[:, 1], "y": rng.integers(0, 3, 240)})
    f = ctx.parallelize(data, 3)
    asked = ctx.parallelize(data.assign(a=[np.nan if i == 7 else v for i, v in enumerate(data["a"])]), 2)
    found = {}
    for block in (50_000, 40):
        for own in (None, "id"):
            m = KNearestNeighbors(1)
            m.block = block
            found[block, own] = {r["id"]: r["prediction_kNN"] for r in m.fit(f, ["a", "b"], "y", id_col=own).transform(asked).df.collect()}
    assert found[50_000, None] == found[40, None] and found[50_000, "id"] == found[40, "id"] and len(found[40, "id"]) == 240
    assert found[40, None][7] is None and all(found[40, None][i] == data["y"][i] for i in range(40, 240))


def test_points_on_shared_borders_are_in_one_polygon(ctx):
    squares = ctx.spark.createDataFrame([(10 * i + j, [[float(i), float(j)], [float(i), j + 1.0], [i + 1.0, j + 1.0], [i + 1.0, float(j)]]) for i in range(2) for j in range(2)], "area long, points array<array<double>>")
    points = frame(ctx, {"lat": [0.0, 0.0, 1.0, 1.0, 2.0, 0.5, None], "lon": [0.0, 1.0, 0.0, 1.0, 1.0, 2.0, 1.0], "k": range(7)}, None)
    got = points.geo_within(Frame(squares), "lat", "lon", attributes=["area"])
    assert {r["k"]: r["area"] for r in got.df.collect()} == {0: 0, 1: 1, 2: 10, 3: 11, 4: None, 5: None, 6: None}
    assert "Exchange" not in got.df._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in got.df._jdf.queryExecution().optimizedPlan().toString()


def test_msr_is_that_of_the_explained_sum(ctx):
    y, p = np.array([1.0, 2.0, 4.0, 7.0, 8.0]), np.array([1.5, 2.0, 3.0, 7.5, 9.0])
    m = RegressionMetrics(["a"], "y", "p", frame(ctx, {"y": y, "p": p}, None))
    sst, sse = ((y - y.mean()) ** 2).sum(), ((y - p) ** 2).sum()
    assert m.msr == pytest.approx(sst - sse) and m.get_metrics()["Metric"].tolist()[-1] == "Mean Square of Regression (MSR)"
