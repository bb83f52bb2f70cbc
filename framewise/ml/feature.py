"""Feature transformers over several columns, one scalar output column per feature."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np

from framewise.ml.base import Column, F, Frame, Model, emit, names, out_names, spark_df, x

#: Categories or terms that a transformer makes columns of, at most.
WIDEST = 10_000


class _Scaler(Model):
    parameters = ("input_col", "stats")

    def __init__(self) -> None:
        self.input_col: list[str] | None = None
        self.stats: list[list[float]] | None = None

    def _aggregates(self, c: str) -> list[Column]:
        raise NotImplementedError

    def _scaled(self, c: Column, s: Sequence[float]) -> Column:
        raise NotImplementedError

    def fit(self, data: Frame, input_col: Sequence[str] | str):
        self.input_col = names(input_col)
        per = [self._aggregates(c) for c in self.input_col]
        row = list(spark_df(data).agg(*[a for p in per for a in p]).first())
        n = len(per[0])
        self.stats = [[0.0 if v is None else float(v) for v in row[i * n : (i + 1) * n]] for i in range(len(per))]
        return self

    def transform(self, data: Frame, input_col: Sequence[str] | str | None = None, output_col: Sequence[str] | str | None = None, remove: bool = False) -> Frame:
        self.check_fitted()
        cols = names(input_col or self.input_col)
        return emit(spark_df(data), {o: self._scaled(x(c).cast("double"), s) for c, o, s in zip(cols, out_names(cols, output_col), self.stats)}, cols, remove)


class MaxAbsScaler(_Scaler):
    """x / max |x|; a column of zeros stays."""

    def _aggregates(self, c):
        return [F.max(F.abs(x(c).cast("double")))]

    def _scaled(self, c, s):
        return c / F.lit(s[0] or 1.0)


class MinMaxScaler(_Scaler):
    """Least to greatest onto ``feature_range``; a constant column becomes its lower end."""

    def __init__(self, feature_range: tuple[float, float] = (0, 1)) -> None:
        super().__init__()
        if feature_range[0] >= feature_range[1]:
            raise ValueError("the range has to rise")
        self.feature_range = list(feature_range)

    def _aggregates(self, c):
        return [F.min(x(c).cast("double")), F.max(x(c).cast("double"))]

    def _scaled(self, c, s):
        lo, hi = self.feature_range
        return (c - F.lit(s[0])) / F.lit((s[1] - s[0]) or 1.0) * F.lit(float(hi - lo)) + F.lit(float(lo))


class StandardScaler(_Scaler):
    """(x - mean) / population deviation; a constant column is only centred."""

    def __init__(self, with_mean: bool = True, with_std: bool = True) -> None:
        super().__init__()
        self.with_mean, self.with_std = with_mean, with_std

    def _aggregates(self, c):
        return [F.avg(x(c).cast("double")), F.stddev_pop(x(c).cast("double"))]

    def _scaled(self, c, s):
        c = c - F.lit(s[0]) if self.with_mean else c
        return c / F.lit(s[1] or 1.0) if self.with_std else c


class PCA(Model):
    """Principal components of the sample covariance; the uncentred data are projected. Signs: the largest weight of a component is positive."""

    parameters = ("input_col", "eig_vectors")

    def __init__(self, n_components: int) -> None:
        self.n_components = n_components
        self.input_col = self.eig_values = self.eig_vectors = self.cum_var_exp = None

    def fit(self, data: Frame, input_col: Sequence[str] | str):
        self.input_col = cols = names(input_col)
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        row = spark_df(data).dropna(subset=[f"`{c}`" for c in cols]).agg(*[F.covar_samp(x(cols[i]).cast("double"), x(cols[j]).cast("double")).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
        cov = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, row):
            cov[i, j] = cov[j, i] = 0.0 if v is None else v
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(cols))])
        self.eig_values, self.eig_vectors = values.tolist(), vectors.tolist()
        self.cum_var_exp = (np.cumsum(values) / (values.sum() or 1.0) * 100).tolist()
        return self

    def transform(self, data: Frame, input_col=None, output_col="_pca", remove: bool = False) -> Frame:
        self.check_fitted()
        cols = names(input_col or self.input_col)
        outs = [f"col{i}{output_col}" for i in range(self.n_components)] if isinstance(output_col, str) else list(output_col)
        new = {o: sum((x(c).cast("double") * F.lit(self.eig_vectors[j][i]) for j, c in enumerate(cols)), F.lit(0.0)) for i, o in enumerate(outs[: self.n_components])}
        return emit(spark_df(data), new, cols, remove)


class Binarizer(Model):
    """1.0 above the threshold, else 0.0; null stays null."""

    def __init__(self, threshold: float = 0.0) -> None:
        self.threshold = threshold

    def fit(self, data, input_col=None):
        self.input_col = names(input_col or [])
        return self

    def transform(self, data: Frame, input_col=None, output_col=None, remove: bool = False) -> Frame:
        cols = names(input_col or self.input_col)
        return emit(spark_df(data), {o: F.when(x(c).isNotNull(), (x(c) > F.lit(self.threshold)).cast("double")) for c, o in zip(cols, out_names(cols, output_col, "_binarized"))}, cols, remove)


def _categories(data: Frame, columns: Sequence[str]) -> list[list[str]]:
    """Sorted known values of each column as texts; numbers sort as numbers."""
    df, kinds, out = spark_df(data), dict(spark_df(data).dtypes), []
    for c in columns:
        rows = df.where(x(c).isNotNull()).select(x(c).alias("v")).distinct().limit(WIDEST + 1).collect()
        if len(rows) > WIDEST:
            raise ValueError(f"{c} has more than {WIDEST} categories")
        out.append([str(v) for v in sorted((r["v"] for r in rows), key=(lambda v: v) if kinds[c] != "string" else str)])
    return out


class OneHotEncoder(Model):
    """0/1 columns ``col<i><suffix>`` for the sorted categories of every input column; unknown ones are all 0."""

    parameters = ("input_col", "categories")

    def __init__(self) -> None:
        self.input_col = self.categories = None

    def fit(self, data: Frame, input_col):
        self.input_col = names(input_col)
        self.categories = _categories(data, self.input_col)
        return self

    def transform(self, data: Frame, input_col=None, output_col: str = "_onehot", remove: bool = False) -> Frame:
        self.check_fitted()
        cols = names(input_col or self.input_col)
        flat = [(c, v) for c, vs in zip(cols, self.categories) for v in vs]
        new = {f"col{i}{output_col}": F.coalesce((x(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)) for i, (c, v) in enumerate(flat)}
        return emit(spark_df(data), new, cols, remove)


class PolynomialExpansion(Model):
    """Products up to ``degree``: 1, a, b, a^2, ab, b^2 ... as ``col<i><suffix>``."""

    def __init__(self, degree: int = 2, interaction_only: bool = False) -> None:
        self.degree, self.interaction_only = degree, interaction_only

    def fit(self, data, input_col=None):
        self.input_col = names(input_col or [])
        return self

    def transform(self, data: Frame, input_col=None, output_col: str = "_poly", remove: bool = False) -> Frame:
        cols = names(input_col or self.input_col)
        if not isinstance(output_col, str):
            raise ValueError("output_col is a suffix")
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        terms = [t for d in range(self.degree + 1) for t in pick(cols, d)]
        new = {}
        for i, t in enumerate(terms):
            product = F.lit(1.0)
            for c in t:
                product = product * x(c).cast("double")
            new[f"col{i}{output_col}"] = product
        return emit(spark_df(data), new, cols, remove)


class StringIndexer(Model):
    """Places of values in one alphabetical list shared by all input columns, from 0; unknown ones are null."""

    parameters = ("input_col", "mapping")

    def __init__(self) -> None:
        self.input_col = self.mapping = None

    def fit(self, data: Frame, input_col):
        self.input_col = names(input_col)
        self.mapping = sorted({v for vs in _categories(data, self.input_col) for v in vs})
        return self

    def transform(self, data: Frame, input_col=None, output_col=None) -> Frame:
        self.check_fitted()
        cols = names(input_col or self.input_col)
        outs = out_names(cols, output_col, "_indexed") if not isinstance(output_col, str) or len(cols) > 1 else [output_col]
        df = spark_df(data)
        # A hash join with the list (bounded by ``fit``): a literal map would be searched from its start for every row.
        table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(self.mapping)], "__fw_value string, __fw_place int")
        work = df
        for i, c in enumerate(cols):
            own = table.select(F.col("__fw_value").alias(f"__fw_value{i}"), F.col("__fw_place").alias(f"__fw_place{i}"))
            work = work.join(F.broadcast(own), x(c).cast("string") == F.col(f"__fw_value{i}"), "left")
        return emit(work, {o: F.col(f"__fw_place{i}") for i, o in enumerate(outs)}, [f"__fw_{w}{i}" for w in ("value", "place") for i in range(len(cols))], True)


class IndexToString(Model):
    """The values that an indexer's places stand for."""

    def __init__(self, model: StringIndexer) -> None:
        self.mapping = list(model.mapping)

    def fit(self, data, input_col=None):
        return self

    def transform(self, data: Frame, input_col, output_col=None) -> Frame:
        cols = names(input_col)
        outs = out_names(cols, output_col, "_converted") if not isinstance(output_col, str) or len(cols) > 1 else [output_col]
        values = F.array(*[F.lit(v) for v in self.mapping])
        return emit(spark_df(data), {o: F.get(values, x(c).cast("int")) for c, o in zip(cols, outs)})


class VectorAssembler(Model):
    """One array column of several numeric columns."""

    def transform(self, data: Frame, input_col, output_col: str = "features", remove: bool = False) -> Frame:
        cols = names(input_col)
        return emit(spark_df(data), {output_col: F.array(*[x(c).cast("double") for c in cols])}, cols, remove)


class VectorSlicer(Model):
    """An array of the elements at ``indices``."""

    def __init__(self, indices: Sequence[int]) -> None:
        self.indices = list(indices)

    def transform(self, data: Frame, input_col: str, output_col: str | None = None, remove: bool = False) -> Frame:
        return emit(spark_df(data), {output_col or f"{input_col}_sliced": F.array(*[F.get(x(input_col), F.lit(i)) for i in self.indices])}, [input_col], remove)
