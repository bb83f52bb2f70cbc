"""Repetition inside a single document: statistics of repeated content and robust multivariate outliers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.plans.scale import cut, join_small

#: Words of a passage.
PASSAGE = 8
VECTOR = "n_words long, phrases_again double, words_again double, top_phrase double, letters_again double"
#: Statistics whose outliers are rejected, each with the least deviation (of the transformed value) that counts as one.
STATS = {"phrases_again": 0.05, "words_again": 0.05, "top_phrase": 0.05, "letters_again": 0.05}
#: Steps of the grid on which transformed statistics are counted for the estimates, from 0 to a right angle.
STEPS = 32
_WORD = re.compile(r"[^\W\d_]+")


class Batch:
    """The words of a batch of texts as one array of codes, with each text's bounds; everything below is vectorised over it."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        self.words, vocabulary = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
        self.letters = np.array([len(w) for w in vocabulary], np.int64)[self.words] if flat else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.end = np.repeat(np.cumsum(self.n), self.n)

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, code) of every run of ``length`` words inside a text; codes by doubling, so equal codes are equal phrases."""
        codes, have = self.words.astype(np.int64), 1
        while have < length:
            step = min(have, length - have)
            left = codes[: max(0, len(codes) - step)]
            codes = pd.factorize(left * (codes.max(initial=0) + 1) + codes[step:])[0].astype(np.int64)
            have += step
        start = np.arange(len(codes))
        inside = start + length <= self.end[: len(codes)]
        return start[inside], codes[inside]

    def first(self, start: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, id): for each phrase the place of the first equal one in its text, and an id of (text, phrase)."""
        ids = pd.factorize(self.doc[start] * (code.max(initial=0) + 1) + code)[0]
        new = np.ones(len(ids), bool)
        if len(ids):
            new[1:] = ids[1:] > np.maximum.accumulate(ids)[:-1]
        return start[new][ids] if len(ids) else start, ids

    def per_text(self, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc[at], weights=weight, minlength=len(self.n))

    def repeated_words(self, passage: int = PASSAGE) -> np.ndarray:
        """By text, the words in passages of ``passage`` words that stand earlier in the text, apart from the passage itself."""
        start, code = self.phrases(passage)
        first, _ = self.first(start, code)
        again = start[first + passage <= start]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + passage, -1)
        return self.per_text(np.flatnonzero(np.cumsum(edge[:-1]) > 0)).astype(np.int64)

    def vector(self) -> pd.DataFrame:
        """The statistics of every text: shares of its three-word phrases, words and letters that are no first
        occurrences, and the share that further copies of its most frequent phrase take."""
        texts = len(self.n)
        many = np.maximum(self.n, 1)
        start, code = self.phrases(3)
        first, ids = self.first(start, code)
        top = np.zeros(texts, np.int64)
        if len(ids):
            counts = np.bincount(ids)
            owner = np.zeros(len(counts), np.int64)
            owner[ids] = self.doc[start]
            np.maximum.at(top, owner, counts)
        place = np.arange(len(self.words))
        first_word, _ = self.first(place, self.words.astype(np.int64))
        again = place[first_word < place]
        letters = np.maximum(self.per_text(place, self.letters), 1)
        # A long text uses its words again in any case; the roots of the lengths take most of that out.
        words_again = 1 - (self.n - self.per_text(again)) / many**0.75
        letters_again = 1 - (letters - self.per_text(again, self.letters[again])) / letters**0.8
        found = {
            "n_words": self.n,
            "phrases_again": self.per_text(start[first < start]) / np.maximum(self.n - 2, 1),
            "words_again": words_again.clip(0, 1),
            "top_phrase": np.minimum(3 * np.maximum(top - 1, 0) / many, 1.0),
            "letters_again": letters_again.clip(0, 1),
        }
        return pd.DataFrame(found).where(pd.Series(self.n > 0), 0)


def repeated_words(words: Sequence[str], passage: int = PASSAGE) -> int:
    """The repeated words of one text."""
    return int(Batch([" ".join(words)]).repeated_words(passage)[0])


def _narrow(df: DataFrame, doc_id: str, text: str, keep: Sequence[str]) -> tuple[DataFrame, str]:
    narrow = df.select(F.col(f"`{doc_id}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__fw_text"))
    return narrow, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def repetition_statistics(df: DataFrame, doc_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., n_words, statistics) of every document; whole texts, in one narrow pass over Arrow batches.

    Words are runs of letters in lower case; punctuation, digits and spacing don't matter. Null and empty texts have
    no words and no repetition.
    """
    narrow, kept = _narrow(df, doc_id, text, keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = Batch(b["__fw_text"].tolist()).vector().astype({"n_words": "int64"})
            yield pd.concat([b.drop(columns="__fw_text").reset_index(drop=True), found], axis=1)

    return narrow.mapInPandas(run, f"{kept}, {VECTOR}")


def repeated_passages(df: DataFrame, doc_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., n_words, repeated_words, repeated_share): the exact share of a text that lies in passages of
    eight or more words standing earlier in the same text, apart from the passage itself. Phrases are told apart by
    codes made by doubling, not by hashes."""
    narrow, kept = _narrow(df, doc_id, text, keep)
    shares = "n_words long, repeated_words long, repeated_share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = Batch(b["__fw_text"].tolist())
            repeated = words.repeated_words()
            found = pd.DataFrame(dict(zip(_columns(shares), (words.n, repeated, repeated / np.maximum(words.n, 1)))))
            yield pd.concat([b.drop(columns="__fw_text").reset_index(drop=True), found], axis=1)

    return narrow.mapInPandas(run, f"{kept}, {shares}")


# Minimum covariance determinant


def chi2_cdf(x: float, p: int) -> float:
    """Distribution of chi-square with ``p`` degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 10.0 * p + 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the ``share`` of normal points with the smallest distances that of all of them."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2) if share < 1 else 1.0


def minimum_covariance_determinant(points: np.ndarray, weights: np.ndarray, floors: np.ndarray, share: float = 0.75, starts: int = 12, best: int = 3, max_steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the ``share`` of weighted points whose covariance has the least determinant.

    Starts are the medians and ``starts - 1`` draws of p + 1 points (fixed seed, chance by weight). Each takes two
    concentration steps - the share of points nearest by Mahalanobis distance gives the next mean and covariance, the
    last point in part - and the ``best`` go on until the determinant falls no further; one that doesn't settle in
    ``max_steps`` is an error. ``floors`` (squared, on the diagonal) keep a statistic that is constant in the kept
    points from making it singular. The covariance is scaled to be consistent for normal points, and then made once
    more from all points within the 97.5 % distance.
    """
    p = points.shape[1]
    ridge = np.diag(floors**2)
    need = share * weights.sum()

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = w @ points / w.sum()
        d = points - mean
        return mean, (d * w[:, None]).T @ d / w.sum()

    def distances(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        d = points - mean
        return np.einsum("ij,ij->i", d @ np.linalg.inv(cov + ridge), d)

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        order = np.argsort(distances(mean, cov), kind="stable")
        upto = np.cumsum(weights[order])
        kept = np.zeros(len(points))
        kept[order] = np.clip(need - (upto - weights[order]), 0, weights[order])
        mean, cov = moments(kept)
        return mean, cov, float(np.linalg.slogdet(cov + ridge)[1])

    rng = np.random.default_rng(17)
    upto = np.cumsum(weights) / weights.sum()
    middle = np.array([points[order[np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)], k] for k, order in enumerate(np.argsort(points, axis=0, kind="stable").T)])
    tries = [step(middle, np.zeros((p, p)))]
    for _ in range(starts - 1):
        drawn = np.zeros(len(points))
        np.add.at(drawn, np.searchsorted(upto, rng.random(p + 1)).clip(0, len(points) - 1), 1.0)
        tries.append(step(*moments(drawn)))
    tries = sorted((step(*t[:2]) for t in tries), key=lambda t: t[2])[:best]
    ends = []
    for t in tries:
        for _ in range(max_steps):
            new = step(*t[:2])
            if new[2] >= t[2] - 1e-9:
                break
            t = new
        else:
            raise RuntimeError(f"the determinant has not settled after {max_steps} steps")
        ends.append(t)
    mean, cov, _ = min(ends, key=lambda t: t[2])
    near = distances(mean, cov * consistency(share, p)) <= chi2_quantile(0.975, p)
    if weights[near].sum() < need:
        return mean, cov * consistency(share, p) + ridge
    mean, cov = moments(np.where(near, weights, 0.0))
    return mean, cov * consistency(0.975, p) + ridge


def _transformed(names: Sequence[str]) -> list[Column]:
    """Shares by arcsine of the root, so that their spread depends little on their size."""
    return [F.asin(F.sqrt(F.least(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))) for c in names]


def _levels(groups: Sequence[str]) -> list[list[str]]:
    return [list(groups), list(groups[:1]), []] if len(groups) > 1 else [list(groups), []] if groups else [[]]


def _level_key(level: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in level])) if level else F.lit("{}")


def robust_estimates(stats: DataFrame, groups: Sequence[str], vector: dict[str, float] = STATS, share: float = 0.75, least: int = 50) -> DataFrame:
    """(level, key, mean, inverse): minimum-covariance-determinant estimates by all ``groups``, by the first of them, and over all rows.

    All rows take part: they are counted on a grid of ``STEPS`` steps of each transformed statistic (with the sums
    of their values, so that means are exact) by one map-side aggregate, and a group's estimate comes from its cells. A
    group has at most STEPS^p cells, whatever its rows, so no task gets an unbounded group. A null is a group of
    its own; groups of fewer than ``least`` rows get no estimate of their own, all rows together always do.
    """
    names, floors = list(vector), np.array(list(vector.values()))
    p = len(names)
    v = [f"__fw_z{i}" for i in range(p)]
    levels = _levels(groups)
    rows = stats.select(*[F.col(f"`{c}`") for c in groups], *[z.alias(c) for z, c in zip(_transformed(names), v)])
    cells = [F.least(F.floor(F.col(c) * F.lit(2 * STEPS / math.pi)), F.lit(STEPS - 1)).cast("int").alias(f"__fw_c{i}") for i, c in enumerate(v)]
    fine = rows.select("*", *cells).groupBy(*[F.col(f"`{c}`") for c in groups], *[f"__fw_c{i}" for i in range(p)]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in v])
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _level_key(level).alias("key")) for k, level in enumerate(levels)])).alias("l")
    every = fine.select("*", keyed).groupBy("l.level", "l.key", *[f"__fw_c{i}" for i in range(p)]).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in v])

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        level, key = int(pdf["level"].iloc[0]), pdf["key"].iloc[0]
        n = pdf["n"].to_numpy(float)
        if n.sum() < least and level < len(levels) - 1:
            return pd.DataFrame([], columns=["level", "key", "mean", "inverse"], dtype=object)
        pdf = pdf.sort_values([f"__fw_c{i}" for i in range(p)])
        n = pdf["n"].to_numpy(float)
        mean, cov = minimum_covariance_determinant(pdf[v].to_numpy(float) / n[:, None], n, floors, share)
        return pd.DataFrame([(level, key, mean.tolist(), np.linalg.inv(cov).ravel().tolist())], columns=["level", "key", "mean", "inverse"])

    return every.groupBy("level", "key").applyInPandas(estimate, "level int, key string, mean array<double>, inverse array<double>")


def with_distance(stats: DataFrame, estimates: DataFrame, groups: Sequence[str], vector: dict[str, float] = STATS, chance: float = 1e-4) -> DataFrame:
    """``stats`` with ``distance`` and ``rejected``: the largest Mahalanobis distance from the estimates of a row's group,
    of the first group and of all rows, and whether it lies beyond what ``chance`` of normal rows do - that is, if the row stands
    out in its group, or the group in the corpus. Estimates are joined by a size-checked broadcast or on key and salt."""
    names = list(vector)
    p = len(names)
    v = [f"__fw_z{i}" for i in range(p)]
    levels = _levels(groups)
    out = stats.withColumns(dict(zip(v, _transformed(names))))
    parts = []
    for k, level in enumerate(levels):
        named = estimates.where(F.col("level") == k).select(F.col("key").alias(f"__fw_l{k}"), F.col("mean").alias(f"__fw_m{k}"), F.col("inverse").alias(f"__fw_i{k}"))
        out = join_small(out.withColumn(f"__fw_l{k}", _level_key(level)), named, [f"__fw_l{k}"], "left")
        d = [F.col(x) - F.col(f"__fw_m{k}")[i] for i, x in enumerate(v)]
        square = sum((d[i] * d[j] * F.col(f"__fw_i{k}")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
        parts.append(F.coalesce(F.sqrt(F.greatest(square, F.lit(0.0))), F.lit(0.0)))
    far = F.greatest(*parts) if len(parts) > 1 else parts[0]
    gone = [*v, *[f"__fw_{x}{k}" for x in "lmi" for k in range(len(levels))]]
    return out.withColumn("distance", far).drop(*gone).withColumn("rejected", F.col("distance") > math.sqrt(chi2_quantile(1 - chance, p)))


def robust_outliers(stats: DataFrame, groups: Sequence[str], vector: dict[str, float] = STATS, share: float = 0.75, chance: float = 1e-4, least: int = 50) -> DataFrame:
    """``stats`` with ``distance`` and ``rejected`` under their own robust estimates (see ``robust_estimates`` and ``with_distance``)."""
    return with_distance(stats, cut(robust_estimates(stats, groups, vector, share, least)), groups, vector, chance)


def repetitive_documents(df: DataFrame, doc_id: str, text: str, groups: Sequence[str], least_share: float = 0.4) -> DataFrame:
    """(doc_id, n_words, repeated_words, repeated_share) of the documents that are rejected as outliers and repeat ``least_share`` of their words.

    The cheap statistics of every document give the estimates; documents far from them are the candidates, and only for
    these the repeated passages are found exactly. Texts are read twice and never shuffled or stored. No text with the
    wanted share looks ordinary: r repeated words in a run are r - 2 repeated three-word phrases, so at least 3/4 of ``least_share`` of
    its phrases are repeated.
    """
    stats = repetition_statistics(df, doc_id, text, groups)
    estimates = cut(robust_estimates(stats, groups))
    whole = df.withColumn("__fw_copy", F.col(f"`{text}`"))
    far = with_distance(repetition_statistics(whole, doc_id, text, [*groups, "__fw_copy"]), estimates, groups).where("rejected")
    exact = repeated_passages(far.select(F.col(f"`{doc_id}`"), "__fw_copy"), doc_id, "__fw_copy")
    return exact.where((F.col("n_words") > 0) & (F.col("repeated_words") >= F.lit(least_share) * F.col("n_words")))
