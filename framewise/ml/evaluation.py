"""Evaluators of classifiers and regressors, each from one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import ClassVar

import pandas as pd

from framewise.ml.base import F, Frame, names, spark_df, x


#: The names under which users look measures up in the tables of ``get_metrics``.
LABELS = {
    "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F-measure (F1)",
    "r2": "R^2 (Explained Variance)", "mse": "Mean Squared Error (MSE)", "rmse": "Root Mean Squared Error (RMSE)", "mae": "Mean Absolute Error (MAE)", "msr": "Mean Square of Regression (MSR)",
}


class Measures:
    """Measures as attributes, and as a table."""

    measures: ClassVar[tuple[str, ...]] = ("accuracy", "precision", "recall", "f1")

    def get_metrics(self) -> pd.DataFrame:
        return pd.DataFrame({"Metric": [LABELS[m] for m in self.measures], "Value": [getattr(self, m) for m in self.measures]})


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _confusion(data: Frame, label_col: str, pred_col: str) -> pd.DataFrame:
    """Counts with actual labels as rows and predicted ones as columns; pairs with a null don't count."""
    df = spark_df(data).where(x(label_col).isNotNull() & x(pred_col).isNotNull())
    counts = df.groupBy(x(label_col).alias("l"), x(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n")).limit(1_000_001).toPandas()
    if len(counts) > 1_000_000:
        raise ValueError("more than 1,000,000 pairs of labels")
    values = sorted({*counts["l"], *counts["p"]})
    return counts.pivot(index="l", columns="p", values="n").reindex(index=values, columns=values).fillna(0).astype("int64")


class BinaryClassificationMetrics(Measures):
    """``accuracy, precision, recall, f1, confusion_matrix`` of a two-class prediction."""

    def __init__(self, label_col: str, pred_col: str, data: Frame, true_label: object = 1) -> None:
        m = self.confusion_matrix = _confusion(data, label_col, pred_col)
        tp = m.at[true_label, true_label] if true_label in m.index else 0
        predicted = m[true_label].sum() if true_label in m.columns else 0
        actual = m.loc[true_label].sum() if true_label in m.index else 0
        total, right = m.to_numpy().sum(), sum(m.at[v, v] for v in m.index)
        self.accuracy = _ratio(right, total)
        self.precision, self.recall = _ratio(tp, predicted), _ratio(tp, actual)
        self.f1 = _ratio(2 * self.precision * self.recall, self.precision + self.recall)


class MultilabelMetrics(Measures):
    """Averages over the classes, and ``precision_recall`` by class."""

    def __init__(self, label_col: str, pred_col: str, data: Frame) -> None:
        m = self.confusion_matrix = _confusion(data, label_col, pred_col)
        rows = []
        for v in m.index:
            p, r = _ratio(m.at[v, v], m[v].sum()), _ratio(m.at[v, v], m.loc[v].sum())
            rows.append((v, p, r, _ratio(2 * p * r, p + r)))
        self.precision_recall = pd.DataFrame(rows, columns=["Label", "Precision", "Recall", "F-Measure"])
        n = len(rows) or 1
        self.accuracy = _ratio(sum(m.at[v, v] for v in m.index), m.to_numpy().sum())
        self.precision, self.recall = sum(r[1] for r in rows) / n, sum(r[2] for r in rows) / n
        self.f1 = _ratio(2 * self.precision * self.recall, self.precision + self.recall)


class RegressionMetrics(Measures):
    """``r2, mse, rmse, mae, msr``; errors are divided by n - features - 1, the explained sum (that of the labels less that of the errors) by the features."""

    measures = ("r2", "mse", "rmse", "mae", "msr")

    def __init__(self, col_features: Sequence[str] | str, label_col: str, pred_col: str, data: Frame) -> None:
        y, p = x(label_col).cast("double"), x(pred_col).cast("double")
        dim = len(names(col_features))
        df = spark_df(data).where(y.isNotNull() & p.isNotNull())
        n, sse, sae, sst = df.agg(F.count(F.lit(1)), F.sum((y - p) * (y - p)), F.sum(F.abs(y - p)), F.var_pop(y) * F.count(y)).first()
        if not n or n - dim - 1 <= 0:
            raise ValueError("too few rows")
        self.r2 = 1 - sse / sst if sst else float("nan")
        self.mse, self.mae = sse / (n - dim - 1), sae / (n - dim - 1)
        self.rmse, self.msr = math.sqrt(self.mse), (sst - sse) / dim
