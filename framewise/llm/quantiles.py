"""Percentiles of very large numeric columns: dyadic Count-sketches that merge by addition and support deletions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.plans.scale import cut

#: Bits of an encoded value; top bits whose counts are kept exactly; rows and columns of a Count-sketch.
BITS, EXACT, DEPTH, WIDTH = 32, 14, 5, 2048
#: Distinct values up to which a sketch is kept as the list of its encoded values; counters follow from it at any time.
LISTED = 4096
#: Sketches that one task adds up in a round of merging.
FAN = 32
SKETCH = "field string, n long, body binary"


def encode(x: np.ndarray) -> np.ndarray:
    """Doubles to 32-bit integers in the same order: the bits of the nearest single (relative error 2^-24)."""
    with np.errstate(over="ignore"):
        bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def decode(k: int) -> float:
    bits = np.uint32(k ^ (1 << 31)) if k >> 31 else np.uint32(~np.uint32(k))
    return float(np.array([bits], np.uint32).view(np.float32)[0])


def _hashes(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(977 + level)
    draw = lambda odd: (r.integers(1, 2**63, DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(odd)
    return draw(1), draw(0), draw(1), draw(0)


_tables = [_hashes(x) for x in range(BITS)]
_SHIFT = np.uint64(64 - int(math.log2(WIDTH)))


def _place(level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each prefix in a row of a level's sketch."""
    a, b, c, d = (x[row] for x in _tables[level])
    with np.errstate(over="ignore"):
        column = (prefix * a + b) >> _SHIFT
        sign = 1 - 2 * ((prefix * c + d) >> np.uint64(63)).astype(np.int64)
    return column.astype(np.int64), sign


class Sketch:
    """One group's values: an exact array for the top bits and a Count-sketch for every finer resolution.

    While few distinct values have come in they are held as a list of (code, weight), which is smaller; counters are
    linear, so those made from the list later are the ones that single additions would have given.
    """

    def __init__(self) -> None:
        self.n = 0
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.levels: list[np.ndarray] | None = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        """Add encoded values, each with a whole weight; -1 deletes one occurrence."""
        self.n += int(weights.sum())
        if self.levels is not None:
            self._count_in(codes, weights)
            return
        found, back = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, np.concatenate([self.counts, weights]))
        self.codes, self.counts = found[total != 0], total[total != 0]
        if len(self.codes) > LISTED:
            self.counters()

    def counters(self) -> list[np.ndarray]:
        """The counters by level, made from the list if there are none yet."""
        if self.levels is None:
            self.levels = [np.zeros((DEPTH, WIDTH), np.int64) for _ in range(BITS - EXACT)] + [np.zeros(1 << EXACT, np.int64)]
            self._count_in(self.codes, self.counts)
            self.codes, self.counts = self.codes[:0], self.counts[:0]
        return self.levels

    def _count_in(self, codes: np.ndarray, weights: np.ndarray) -> None:
        top = BITS - EXACT
        np.add.at(self.levels[top], (codes >> np.uint64(top)).astype(np.int64), weights)
        for level in range(top):
            prefix = codes >> np.uint64(level)
            for row in range(DEPTH):
                column, sign = _place(level, row, prefix)
                np.add.at(self.levels[level][row], column, sign * weights)

    def merge(self, other: "Sketch") -> None:
        """Add another sketch."""
        if other.levels is None:
            self.add(other.codes, other.counts)
            return
        self.n += other.n
        for own, more in zip(self.counters(), other.levels):
            own += more

    def body(self) -> bytes:
        if self.levels is None:
            return b"L" + zlib.compress(self.codes.astype("<u4").tobytes() + self.counts.astype("<i8").tobytes(), 1)
        flat = np.concatenate([x.ravel() for x in self.levels])
        kind = "<i4" if np.abs(flat).max(initial=0) < 2**31 else "<i8"
        return kind[1:].encode() + zlib.compress(flat.astype(kind).tobytes(), 1)

    @classmethod
    def of(cls, n: int, body: bytes) -> "Sketch":
        s = cls()
        s.n = int(n)
        if body[:1] == b"L":
            data = zlib.decompress(body[1:])
            size = len(data) // 12
            s.codes, s.counts = np.frombuffer(data, "<u4", size).astype(np.uint64), np.frombuffer(data, "<i8", size, 4 * size).copy()
            return s
        flat = np.frombuffer(zlib.decompress(body[2:]), "<" + body[:2].decode()).astype(np.int64)
        cells = DEPTH * WIDTH
        s.levels = [flat[k * cells : (k + 1) * cells].reshape(DEPTH, WIDTH).copy() for k in range(BITS - EXACT)] + [flat[(BITS - EXACT) * cells :].copy()]
        return s

    def _count(self, level: int, prefixes: np.ndarray) -> np.ndarray:
        """Estimated counts of prefixes: medians over the rows of a level."""
        found = np.empty((DEPTH, len(prefixes)))
        for row in range(DEPTH):
            column, sign = _place(level, row, prefixes)
            found[row] = sign * self.counters()[level][row, column]
        return np.median(found, axis=0)

    def quantiles(self, qs: Sequence[float]) -> list[float | None]:
        """The values at ranks ceil(q n), found by descending the resolutions with the ranks that are left."""
        if self.n <= 0:
            return [None] * len(qs)
        top = BITS - EXACT
        rank = np.array([max(1, math.ceil(round(q * self.n, 9))) for q in qs], float)
        exact = self.counters()[top].astype(float)
        upto = np.cumsum(exact)
        prefix = np.minimum(np.searchsorted(upto, rank), (1 << EXACT) - 1)
        inside = exact[prefix]
        left = rank - (upto[prefix] - inside)
        for level in range(top - 1, -1, -1):
            lower = np.clip(self._count(level, (2 * prefix).astype(np.uint64)), 0, inside)
            down = left <= lower
            prefix = 2 * prefix + ~down
            left, inside = np.where(down, left, left - lower), np.where(down, lower, inside - lower)
        return [decode(int(k)) for k in prefix]

    def rank_error(self) -> float:
        """Error of a rank that a descent all but never exceeds, as a share of the values.

        A count is the median over ``DEPTH`` rows, so it is off by more than the 95th percentile of a level's counters
        only if three of five rows are, one time in about a thousand. The errors of the
        ``BITS - EXACT`` levels have random signs and add by squares; one rank is added for rounding. Read off the counters
        themselves, the percentile follows the data: few distinct values leave most counters empty.
        """
        if self.n <= 0:
            return 0.0
        size = DEPTH * WIDTH
        far = [float(np.partition(np.abs(x).ravel(), int(0.95 * size))[int(0.95 * size)]) for x in self.counters()[: BITS - EXACT]]
        return min(1.0, (math.sqrt(sum(f * f for f in far)) + 1) / self.n)


def _keys(keys: Sequence[str]):
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")


def _named(rows: DataFrame, schema: T.StructType, keys: Sequence[str], *rest: str) -> DataFrame:
    """``rows`` with the key columns read back from their text."""
    kinds = T.StructType([T.StructField(k, schema[k].dataType) for k in keys])
    return rows.withColumn("__fw_s", F.from_json("__fw_k", kinds)).select(*[F.col("__fw_s")[k].alias(k) for k in keys], *rest)


def sketch(df: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: str | None = None) -> DataFrame:
    """Sketches of ``fields`` by ``keys``: rows (keys, field, n, body), one per group and field.

    Nulls and NaNs are no values; infinities are; a null key is a key; ``weight`` is a column of whole
    numbers, -1 for a deletion (null counts 0). A task sorts its own rows by group and makes one sketch after the
    other, so it holds one group at a time whatever their number, and hands on one body of bounded size for
    each; those of the same group are added up in a tree. An empty table gives no rows.
    """
    key = _keys(keys)
    w = F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    narrow = df.select(key.alias("__fw_k"), *[F.col(f"`{f}`").cast("double").alias(f"__fw_{i}") for i, f in enumerate(fields)], w.alias("__fw_w"))
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, {}

        def out() -> pd.DataFrame:
            rows = [(current, f, s.n, s.body()) for f, s in held.items()]
            return pd.DataFrame(rows, columns=["__fw_k", "field", "n", "body"])

        for batch in batches:
            groups = batch["__fw_k"].to_numpy()
            ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups))
            weights = batch["__fw_w"].to_numpy()
            columns = [batch[f"__fw_{i}"].to_numpy(dtype=np.float64, na_value=np.nan) for i in range(len(names))]
            start = 0
            for end in ends if len(groups) else []:
                if groups[start] != current:
                    if held:
                        yield out()
                    current, held = groups[start], {}
                for name, x in zip(names, columns):
                    part = x[start:end]
                    ok = ~np.isnan(part)
                    if ok.any():
                        held.setdefault(name, Sketch()).add(encode(part[ok]), weights[start:end][ok])
                start = end
        if held:
            yield out()

    made = cut(narrow.sortWithinPartitions("__fw_k").mapInPandas(run, "__fw_k string, " + SKETCH))
    return _named(_added(made), df.schema, keys, "field", "n", "body")


def _added(rows: DataFrame) -> DataFrame:
    """Bodies summed by key and field, at most about ``FAN`` in a task: rounds of partial sums until each group has one task's worth."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Sketch()
        for n, body in zip(pdf["n"], pdf["body"]):
            total.merge(Sketch.of(n, body))
        return pd.DataFrame([(pdf["__fw_k"].iloc[0], pdf["field"].iloc[0], total.n, total.body())], columns=["__fw_k", "field", "n", "body"])

    schema = "__fw_k string, " + SKETCH
    while True:
        most = rows.groupBy("__fw_k", "field").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        if most <= 1:
            return rows
        if most <= FAN:
            return rows.groupBy("__fw_k", "field").applyInPandas(add, schema)
        parts = -(-most // FAN)
        # Rows of a group are dealt out by their contents, so that a recomputed task deals them out alike.
        spread = rows.withColumn("__fw_part", F.pmod(F.xxhash64("n", "body"), F.lit(2 * parts)))
        rows = cut(spread.groupBy("__fw_k", "field", "__fw_part").applyInPandas(add, schema))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of separate loads added up by ``keys`` (a subset of theirs)."""
    return _named(_added(sketches.select(_keys(keys).alias("__fw_k"), "field", "n", "body")), sketches.schema, keys, "field", "n", "body")


def percentiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(keys, field, q, n, value, rank_error) of every sketch: ``value`` has a rank within ``rank_error * n``
    of ceil(q n) (stated by the sketch itself, see ``Sketch.rank_error``), and is off by 2^-24 of itself at most."""
    qs = [float(q) for q in quantiles]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, field, n, body in batch.itertuples(index=False):
                s = Sketch.of(n, body)
                e = s.rank_error()
                rows += [(k, field, q, s.n, v, e) for q, v in zip(qs, s.quantiles(qs))]
            yield pd.DataFrame(rows, columns=["__fw_k", "field", "q", "n", "value", "rank_error"])

    # Sketches are small and dear to evaluate: as many tasks as there are cores, however little data they are.
    spread = sketches.select(_keys(keys).alias("__fw_k"), "field", "n", "body").repartition(sketches.sparkSession.sparkContext.defaultParallelism, "__fw_k", "field")
    found = spread.mapInPandas(ask, "__fw_k string, field string, q double, n long, value double, rank_error double")
    return _named(found, sketches.schema, keys, "field", "q", "n", "value", "rank_error")
