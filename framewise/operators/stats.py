"""Descriptive statistics, contingency tables, frequent items and the one-sample Kolmogorov-Smirnov test."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.partition import with_position
from framewise.plans.scale import free_name

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Largest contingency table: columns and rows.
WIDEST, LONGEST = 10_000, 1_000_000


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``column, count, mean, std, min, max, nan_count``.

    ``count`` is of all rows; mean and sample deviation are of known numbers; min and max are texts, so
    that columns of any type share the table. One aggregate over the data.
    """
    kinds = dict(df.dtypes)
    cols = [c for c in (columns or df.columns) if c in kinds]
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        numeric = kinds[c].split("(")[0] in (*NUMERIC, "decimal")
        x = F.when(~F.isnan(x), x) if kinds[c] in ("float", "double") else x
        aggs += [F.avg(x).alias(f"m{i}") if numeric else F.lit(None).cast("double").alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}") if numeric else F.lit(None).cast("double").alias(f"s{i}")]
        aggs += [F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"h{i}"), F.count(x).alias(f"k{i}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col("n").alias("count"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), (F.col("n") - F.col(f"k{i}")).alias("nan_count")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def correlation(df: DataFrame, a: str, b: str) -> float:
    """Pearson correlation to 5 decimals; NaN if a deviation is 0."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    both = df.where(x.isNotNull() & y.isNotNull())
    c, sx, sy = both.agg(F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)).first()
    return round(c / sx / sy, 5) if c is not None and sx and sy else float("nan")


def covariance(df: DataFrame, a: str, b: str) -> float:
    """Sample covariance to 5 decimals; one row has none."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    r = df.select(F.covar_samp(x, y)).first()[0]
    if r is None or math.isnan(r):
        raise ValueError("covariance needs at least two rows")
    return round(r, 5)


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of ``a`` (rows, column ``key``) by ``b`` (columns, by name). Pairs with a null don't count.

    Pairs are counted once; the table is turned from the counts. More than 10,000 columns or 1,000,000 rows are refused.
    """
    pairs = df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).groupBy(F.col(f"`{a}`").cast("string").alias("key"), F.col(f"`{b}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.persist()
    try:
        wide, long = pairs.agg(F.count_distinct("v"), F.count_distinct("key")).first()
        if wide > WIDEST or long > LONGEST:
            raise ValueError(f"a table of {long} x {wide} is too large")
        values = sorted(r[0] for r in pairs.select("v").distinct().collect())
    finally:
        pairs.unpersist()
    return pairs.groupBy("key").pivot("v", values).agg(F.sum("n")).fillna(0) if values else pairs.select("key").distinct()


def freq_items(df: DataFrame, columns: Sequence[str], support: float = 0.01) -> DataFrame:
    """Candidates for items in at least ``support`` of the rows: one row, ``<column>_freqItems``; none that qualifies is missing."""
    return df.stat.freqItems([f"`{c}`" if "." in c else c for c in columns], support)


def exact_freq_items(df: DataFrame, column: str, support: float = 0.01) -> DataFrame:
    """(item, count) of exactly those items."""
    n = df.count()
    return df.groupBy(F.col(f"`{column}`").alias("item")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= support * n)


def _gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    out = np.zeros_like(x, float)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = np.full_like(v, 1.0 / a)
        total = term.copy()
        for n in range(1, 1000):
            term = term * v / (a + n)
            total += term
            if np.all(np.abs(term) < 1e-16 * np.abs(total)):
                break
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        v = x[high]
        b = v + 1 - a
        c = np.full_like(v, 1e300)
        d = 1 / b
        h = d.copy()
        for n in range(1, 1000):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = 1 - h * np.exp(-v + a * np.log(v) - math.lgamma(a))
    return out


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


#: name: (distribution function of the standard form, how many shape parameters)
DISTRIBUTIONS = {
    "norm": (lambda z: 0.5 * _erfc(-z / math.sqrt(2)), 0),
    "uniform": (lambda z: np.clip(z, 0, 1), 0),
    "expon": (lambda z: np.where(z > 0, 1 - np.exp(-np.maximum(z, 0)), 0), 0),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), 0),
    "laplace": (lambda z: np.where(z < 0, 0.5 * np.exp(np.minimum(z, 0)), 1 - 0.5 * np.exp(-np.maximum(z, 0))), 0),
    "cauchy": (lambda z: 0.5 + np.arctan(z) / math.pi, 0),
    "rayleigh": (lambda z: np.where(z > 0, 1 - np.exp(-(z**2) / 2), 0), 0),
    "gumbel_r": (lambda z: np.exp(-np.exp(-z)), 0),
    "gamma": (lambda z, a: _gamma_p(a, z), 1),
    "chi2": (lambda z, k: _gamma_p(k / 2, z / 2), 1),
    "lognorm": (lambda z, s: np.where(z > 0, 0.5 * _erfc(-np.log(np.maximum(z, 1e-300)) / (s * math.sqrt(2))), 0), 1),
    "weibull_min": (lambda z, c: np.where(z > 0, 1 - np.exp(-np.power(np.maximum(z, 0), c)), 0), 1),
    "pareto": (lambda z, b: np.where(z > 1, 1 - np.power(np.maximum(z, 1), -b), 0), 1),
}


def _kolmogorov(x: float) -> float:
    """Survival function of the limit distribution."""
    if x <= 0:
        return 1.0
    if x < 1.0:
        t = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 60))
        return 1 - math.sqrt(2 * math.pi) / x * t
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 60))


def _one_sided(d: float, n: int) -> float:
    """Exact survival function of the one-sided statistic (Birnbaum and Tingey)."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    total = 0.0
    for j in range(int(n * (1 - d)) + 1):
        a, b = 1 - d - j / n, d + j / n
        if a <= 0:
            continue
        total += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + (n - j) * math.log(a) + (j - 1) * math.log(b))
    return min(1.0, d * total)


def ks_one_sample(df: DataFrame, column: str, distribution: str = "norm", mode: str = "asymp", args: Sequence[float] = ()) -> tuple[float, float]:
    """(D, p) of the one-sample Kolmogorov-Smirnov test, to 10 decimals; ``args`` are shape, location, scale.

    A range-partitioned sort gives every value its rank (no single task sees all rows); the distribution
    function is evaluated on Arrow batches. ``asymp`` takes p from the limit distribution;
    ``approx`` from twice the exact one-sided value for small samples.
    """
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"distribution must be one of {sorted(DISTRIBUTIONS)}")
    f, shapes = DISTRIBUTIONS[distribution]
    shape, rest = list(args[:shapes]), list(args[shapes:])
    loc, scale = (rest + [0.0, 1.0][len(rest) :])[:2]

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        z = (x.to_numpy(float) - loc) / scale
        return pd.Series(f(z, *shape))

    x = F.col(f"`{column}`").cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x")).orderBy("x")
    place = free_name("place", ["x"])
    ranked = with_position(known, place)
    n = known.count()
    if not n:
        return float("nan"), float("nan")
    both = ranked.select(cdf("x").alias("f"), F.col(place).alias("r"))
    d = both.agg(F.max(F.greatest((F.col("r") + 1) / F.lit(n) - F.col("f"), F.col("f") - F.col("r") / F.lit(n)))).first()[0]
    if mode == "approx" and n <= 2666 and d <= 0.80 - n * 0.3 / 1000:
        p = min(1.0, 2 * _one_sided(d, n))
    elif mode in ("asymp", "approx"):
        p = _kolmogorov(d * math.sqrt(n))
    else:
        raise ValueError("mode must be asymp or approx")
    return round(d, 10), round(min(max(p, 0.0), 1.0), 10)
