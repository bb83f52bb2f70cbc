"""Classifiers and regressors. Training is a few map-side aggregates a step; prediction is a projection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from framewise.ml.base import Column, DataFrame, F, Frame, Model, emit, names, spark_df, x
from framewise.plans.scale import cut, free_name


def _features(columns: Sequence[str]) -> list[Column]:
    return [x(c).cast("double") for c in columns]


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[f"`{c}`" for c in columns])


def _dot(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    return sum((c * F.lit(float(w)) for c, w in zip(cols, weights)), F.lit(0.0))


class KNearestNeighbors(Model):
    """Majority of the ``k`` nearest training rows (Euclid); ties go to the class with the nearest one, equal distances to the smaller label.

    Up to ``block`` training rows are broadcast. More are dealt into blocks, and query points into parts, that meet
    pair by pair in tasks of their own. Rows without a feature get no prediction.
    """

    block = 50_000

    def __init__(self, k: int = 3) -> None:
        self.k = k

    def fit(self, data: Frame, feature_col: Sequence[str] | str, label_col: str, id_col: str | None = None):
        """With ``id_col`` a row isn't its own neighbour: training rows of the same id are left out for it."""
        self.feature_col, self.label_col, self.id_col = names(feature_col), label_col, id_col
        key = x(id_col) if id_col else F.lit(0)
        self._train = _known(spark_df(data).select(key.alias("__fw_id"), *[x(c) for c in self.feature_col], x(label_col)), [*self.feature_col, label_col])
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "prediction_kNN") -> Frame:
        cols = names(feature_col or self.feature_col)
        df, k, label = spark_df(data), self.k, self._train.schema[self.label_col].dataType
        train = cut(self._train)
        # Labels travel as places in a sorted list.
        labels = [r[0] for r in train.select(x(self.label_col)).distinct().orderBy(x(self.label_col)).limit(10_001).collect()]
        if len(labels) > 10_000:
            raise ValueError("more than 10,000 classes")
        place = train.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], T.StructType([T.StructField("__fw_label", label), T.StructField("__fw_l", T.IntegerType())]))
        train = train.join(F.broadcast(place), x(self.label_col) == F.col("__fw_label")).select(F.col("__fw_id").cast("string").alias("id"), F.array(*_features(self.feature_col)).alias("f"), F.col("__fw_l").alias("l"))
        hits = free_name("__fw_near", df.columns)
        own = x(self.id_col).cast("string") if self.id_col else F.lit(None).cast("string")
        if train.limit(self.block + 1).count() <= self.block:
            rows = train.collect()
            shared = df.sparkSession.sparkContext.broadcast((np.array([r["f"] for r in rows], float).reshape(len(rows), len(cols)), np.array([r["l"] for r in rows], np.int32), np.array([r["id"] for r in rows], object)))
            out = df.withColumn(hits, _nearest(shared, k, bool(self.id_col))(own, *_features(cols)))
        else:
            out = self._in_blocks(df, train, cols, own, hits)
        best = F.array_sort(F.transform(F.array_distinct(F.transform(hits, lambda h: h["l"])), lambda c: F.struct((-F.size(F.filter(F.col(hits), lambda h: h["l"] == c))).alias("n"), F.array_position(F.transform(F.col(hits), lambda h: h["l"]), c).alias("p"), c.alias("l"))))
        values = F.array(*[F.lit(v) for v in labels]) if labels else F.array().cast(T.ArrayType(label))
        return emit(out, {pred_col: F.get(values, F.get(best, F.lit(0))["l"])}, [hits], True)

    def _in_blocks(self, df: DataFrame, train: DataFrame, cols: Sequence[str], own: Column, hits: str) -> DataFrame:
        """``df`` with the nearest training rows of all blocks.

        Distinct query points and training rows are dealt into parts and blocks of about ``block`` rows; a task gets one pair of
        them and gives each point's nearest in that block, and the nearest of all blocks are taken by point. Nothing goes through the driver.
        """
        k, use_id = self.k, bool(self.id_col)
        queries = cut(df.select(F.array(*_features(cols)).alias("f"), own.alias("id")).where(~F.exists("f", lambda v: v.isNull() | F.isnan(v))).distinct())
        blocks, parts = [max(1, -(-2 * f.count() // self.block)) for f in (train, queries)]
        deal = lambda n: F.pmod(F.xxhash64("f", "id"), F.lit(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumns({"part": deal(parts)}).withColumn("block", copies(blocks))
        right = train.withColumns({"block": deal(blocks)}).withColumn("part", copies(parts))

        def near(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame([], columns=["f", "id", "near"], dtype=object)
            points = np.array(t["f"].tolist(), float).reshape(len(t), len(cols))
            found = nearest(np.array(q["f"].tolist(), float), q["id"].to_numpy(object) if use_id else None, points, t["l"].to_numpy(), t["id"].to_numpy(object), k)
            return pd.DataFrame({"f": q["f"], "id": q["id"], "near": pd.Series(found, index=q.index, dtype=object)})

        each = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(near, f"f array<double>, id string, near {NEAR}")
        best = each.groupBy("f", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias(hits))  # k a block
        best = best.select(F.col("f").alias("__fw_f"), F.col("id").alias("__fw_i"), hits)
        return df.join(best, (F.array(*_features(cols)) == F.col("__fw_f")) & own.eqNullSafe(F.col("__fw_i")), "left").drop("__fw_f", "__fw_i").withColumn(hits, F.coalesce(F.col(hits), F.array().cast(NEAR)))


NEAR = "array<struct<d:double,l:int>>"


def nearest(q: np.ndarray, ids: np.ndarray | None, points: np.ndarray, labels: np.ndarray, owners: np.ndarray, k: int) -> list[list[dict]]:
    """The ``k`` nearest points of each query row (distance, label), nearest first, without those of its own id; none for rows with a NaN."""
    own: dict = {}
    for i, o in enumerate(owners if ids is not None else []):
        own.setdefault(o, []).append(i)
    square, out = (points**2).sum(axis=1), []
    for at in range(0, len(q), 512):
        part = q[at : at + 512]
        d = np.maximum(square[None, :] - 2 * part @ points.T + (part**2).sum(axis=1)[:, None], 0) if len(points) else np.zeros((len(part), 0))
        for r, key in enumerate(ids[at : at + 512] if own else []):
            d[r, own.get(key, [])] = np.inf
        m = min(k, d.shape[1])
        # As far as the k-th nearest, and those as far as it up to rounding: which of equal ones come first is for their labels to say.
        reach = np.partition(d, m - 1, axis=1)[:, m - 1] if m else np.zeros(len(part))
        for r, limit in enumerate(reach):
            idx = np.flatnonzero((d[r] <= limit * (1 + 1e-9) + 1e-9) & np.isfinite(d[r])) if m else np.zeros(0, int)
            exact = ((points[idx] - part[r]) ** 2).sum(axis=1)
            out.append([] if np.isnan(part[r]).any() else [{"d": float(v), "l": int(n)} for v, n in sorted((v, labels[i]) for v, i in zip(exact, idx))[:m]])
    return out


def _nearest(shared, k: int, use_id: bool):
    @F.pandas_udf(NEAR)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        points, labels, owners = shared.value
        for ids, *cols in batches:
            q = np.column_stack([c.to_numpy(float) for c in cols])
            yield pd.Series(nearest(q, ids.to_numpy(object) if use_id else None, points, labels, owners, k), dtype=object)

    return run


class GaussianNB(Model):
    """Class means and population variances, equal priors."""

    parameters = ("feature_col", "classes")

    def __init__(self) -> None:
        self.feature_col = self.classes = None

    def fit(self, data: Frame, feature_col, label_col: str):
        self.feature_col = cols = names(feature_col)
        df = _known(spark_df(data), [*cols, label_col])
        rows = df.groupBy(x(label_col).alias("l")).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(_features(cols))], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(_features(cols))]).orderBy("l").limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("more than 10,000 classes")
        spread = max((r[f"v{i}"] for r in rows for i in range(len(cols))), default=0.0)
        self.classes = [[r["l"], [r[f"m{i}"] for i in range(len(cols))], [r[f"v{i}"] + 1e-9 * (spread or 1.0) for i in range(len(cols))]] for r in rows]
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "prediction_GaussianNB") -> Frame:
        self.check_fitted()
        cols = _features(names(feature_col or self.feature_col))
        # Arrays, not a term for every feature and class: the plan stays small with many of them.
        row, scores = F.array(*cols), []
        for i, (_, means, variances) in enumerate(self.classes):
            base = -0.5 * sum(math.log(2 * math.pi * v) for v in variances)
            squares = F.zip_with(row, F.lit(means), lambda c, m: (c - m) * (c - m))
            apart = F.aggregate(F.zip_with(squares, F.lit([2 * v for v in variances]), lambda q, w: q / w), F.lit(0.0), lambda t, q: t + q)
            scores.append(F.struct((F.lit(base) - apart).alias("s"), F.lit(-i).alias("i")))
        values = F.array(*[F.lit(c[0]) for c in self.classes])
        best = F.transform(F.array(F.array_max(F.array(*scores))), lambda b: F.when(b["s"].isNotNull(), F.get(values, -b["i"])))
        return emit(spark_df(data), {pred_col: F.get(best, F.lit(0))})


class LogisticRegression(Model):
    """Two classes 0 and 1 by batch gradient ascent with an intercept, from zero weights, with an L2 penalty."""

    parameters = ("feature_col", "theta")

    def __init__(self, alpha: float = 0.1, regularization: float = 0.1, max_iter: int = 100, threshold: float = 0.01) -> None:
        self.alpha, self.regularization, self.max_iter, self.threshold = alpha, regularization, max_iter, threshold
        self.feature_col = self.theta = None

    def fit(self, data: Frame, feature_col, label_col: str):
        self.feature_col = names(feature_col)
        df = cut(_known(spark_df(data).select(*[c.alias(f"x{i}") for i, c in enumerate(_features(self.feature_col))], x(label_col).cast("double").alias("y")), ["y"] + [f"x{i}" for i in range(len(self.feature_col))]))
        d = len(self.feature_col)
        cols = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(d)]
        theta = np.zeros(d + 1)
        for step in range(self.max_iter):
            p = 1 / (1 + F.exp(-_dot(cols, theta)))
            row = df.select((F.col("y") - p).alias("e"), *[F.col(f"x{i}") for i in range(d)]).agg(F.count(F.lit(1)), F.sum("e"), *[F.sum(F.col("e") * F.col(f"x{i}")) for i in range(d)]).first()
            if not row[0]:
                break
            gradient = np.array([0.0 if v is None else v for v in row[1:]]) / row[0]
            penalty = self.regularization * theta / row[0]
            penalty[0] = 0.0
            change = self.alpha / math.sqrt(1 + step / self.max_iter) * (gradient - penalty)
            theta = theta + change
            if np.abs(change).max() < self.threshold * self.alpha * 0.1:
                break
        self.theta = theta.tolist()
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "prediction_LogReg") -> Frame:
        self.check_fitted()
        cols = [F.lit(1.0), *_features(names(feature_col or self.feature_col))]
        return emit(spark_df(data), {pred_col: F.rint(1 / (1 + F.exp(-_dot(cols, self.theta))))})


class SVM(Model):
    """Linear machine without intercept for labels -1 and 1: hinge loss and lambda |w|^2 by gradient descent."""

    parameters = ("feature_col", "weights")

    def __init__(self, coef_lambda: float = 0.1, coef_lr: float = 0.01, threshold: float = 0.001, max_iter: int = 100, penalty: str = "l2", force: bool = False) -> None:
        if penalty not in ("l1", "l2"):
            raise ValueError("penalty must be l1 or l2")
        self.coef_lambda, self.coef_lr, self.threshold, self.max_iter, self.penalty, self.force = coef_lambda, coef_lr, threshold, max_iter, penalty, force
        self.feature_col = self.weights = self.loss = None

    def fit(self, data: Frame, feature_col, label_col: str):
        """``force`` runs all iterations whatever the loss does."""
        self.feature_col = names(feature_col)
        d = len(self.feature_col)
        df = cut(_known(spark_df(data).select(*[c.alias(f"x{i}") for i, c in enumerate(_features(self.feature_col))], x(label_col).cast("double").alias("y")), ["y"] + [f"x{i}" for i in range(d)]))
        w, last = np.zeros(d), math.inf
        cols = [F.col(f"x{i}") for i in range(d)]
        for _ in range(self.max_iter):
            margin = F.col("y") * _dot(cols, w)
            row = df.select(*cols, "y", margin.alias("m")).agg(F.count(F.lit(1)), F.sum(F.greatest(1 - F.col("m"), F.lit(0.0))), *[F.sum(F.when(F.col("m") < 1, -F.col("y") * c).otherwise(F.lit(0.0))) for c in cols]).first()
            if not row[0]:
                break
            norm = float(np.abs(w).sum() if self.penalty == "l1" else (w**2).sum())
            loss = row[1] / row[0] + self.coef_lambda * norm
            self.loss = loss
            if not self.force and last - loss < self.threshold and last != math.inf:
                break
            last = loss
            pull = np.sign(w) if self.penalty == "l1" else 2 * w
            w = w - self.coef_lr * (np.array(row[2:]) / row[0] + self.coef_lambda * pull)
        self.weights = w.tolist()
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "prediction_SVM") -> Frame:
        self.check_fitted()
        score = _dot(_features(names(feature_col or self.feature_col)), self.weights)
        return emit(spark_df(data), {pred_col: F.when(score.isNotNull(), F.when(score >= 0, 1.0).otherwise(-1.0))})


class OrdinaryLeastSquares(Model):
    """One feature: slope and intercept in closed form; rows with a null don't count."""

    parameters = ("feature_col", "b1")

    def __init__(self) -> None:
        self.feature_col = self.b0 = self.b1 = None

    def fit(self, data: Frame, feature_col, label_col: str):
        self.feature_col = names(feature_col)
        if len(self.feature_col) != 1:
            raise ValueError("one feature, please")
        f, y = x(self.feature_col[0]).cast("double"), x(label_col).cast("double")
        self.b1, self.b0 = spark_df(data).agg(F.regr_slope(y, f), F.regr_intercept(y, f)).first()
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "pred_LinearReg") -> Frame:
        self.check_fitted()
        return emit(spark_df(data), {pred_col: x(names(feature_col or self.feature_col)[0]).cast("double") * F.lit(self.b1) + F.lit(self.b0)})


class GDRegressor(Model):
    """Least squares with an intercept by full gradient descent.

    The sums of products of the features are all that a step needs, so the data are read once, whatever
    the number of steps. Starts at zero; ends when the loss falls by less than ``tol`` of itself. A step that would
    raise the loss is halved.
    """

    parameters = ("feature_col", "theta")

    def __init__(self, max_iter: int = 100, alpha: float = 1, tol: float = 1e-3) -> None:
        self.max_iter, self.alpha, self.tol = max_iter, alpha, tol
        self.feature_col = self.theta = None

    def fit(self, data: Frame, feature_col, label_col: str):
        self.feature_col = names(feature_col)
        df = _known(spark_df(data), [*self.feature_col, label_col])
        cols = [F.lit(1.0), *_features(self.feature_col), x(label_col).cast("double")]
        m = len(cols)
        row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]).first()
        s = np.zeros((m, m))
        k = 0
        for i in range(m):
            for j in range(i, m):
                s[i, j] = s[j, i] = row[k] or 0.0
                k += 1
        n = s[0, 0]
        theta = np.zeros(m - 1)
        loss = lambda t: (s[-1, -1] - 2 * t @ s[:-1, -1] + t @ s[:-1, :-1] @ t) / (2 * n)
        rate, before = self.alpha, loss(theta) if n else 0.0
        for _ in range(self.max_iter if n else 0):
            gradient = (s[:-1, :-1] @ theta - s[:-1, -1]) / n
            new, after = theta, math.inf
            while rate > 1e-15:
                new = theta - rate * gradient
                after = loss(new)
                if after <= before:
                    break
                rate /= 2
            theta = new
            if before - after <= self.tol * abs(before) * 1e-3:
                break
            before = after
        self.theta = theta.tolist()
        return self

    def transform(self, data: Frame, feature_col=None, pred_col: str = "pred_LinearReg") -> Frame:
        self.check_fitted()
        return emit(spark_df(data), {pred_col: _dot([F.lit(1.0), *_features(names(feature_col or self.feature_col))], self.theta)})
