"""Positions, exact samples and explicit partitionings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.plans.scale import cut, free_name, join_small, store

#: Hashes of one bucket that the driver looks at once the others are counted out.
BUCKET = 100_000


def partition_counts(df: DataFrame) -> list[int]:
    """Rows of every partition, empty ones too."""
    rows = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["p"]: r["n"] for r in rows}
    return [found.get(k, 0) for k in range(max(df.rdd.getNumPartitions(), max(found, default=-1) + 1))]


def with_position(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in partition order: a count per partition, then its offset plus the place inside."""
    mid, part = free_name("__fw_mid", df.columns), free_name("__fw_pid", df.columns)
    marked = df.withColumn(mid, F.monotonically_increasing_id()).withColumn(part, F.shiftright(mid, 33))
    counts = marked.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    start = free_name("__fw_start", df.columns)
    offsets = cut(counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(start)))
    placed = join_small(marked, offsets, [part])
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(name))


def zip_columns(left: DataFrame, right: DataFrame, suffixes: Sequence[str] = ("_l", "_r")) -> DataFrame:
    """Columns of both sides, row by row in order, as long as the shorter; clashing names get suffixes."""
    clash = set(left.columns) & set(right.columns)
    a = left.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(c + suffixes[1] if c in clash else c) for c in right.columns])
    place = free_name("__fw_place", a.columns + b.columns)
    return with_position(a, place).join(with_position(b, place), place).orderBy(place).drop(place)


def _row_hash(df: DataFrame, seed: int) -> Column:
    """60 bits of a hash of the whole row: the same in every run, however the rows are distributed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), 4)


def _cutoff(df: DataFrame, n: int, seed: int) -> tuple[int, int]:
    """(hash, k): rows under ``hash`` are fewer than or as many as ``n``; ``k`` of those with that very hash are missing."""
    lo, bits, left = 0, 60, n
    h = store(df.select(_row_hash(df, seed).alias("h")))  # the rounds read eight bytes a row, not the rows
    while True:
        inside = h.where((F.col("h") >= lo) & (F.col("h") < lo + (1 << bits)))
        step = min(12, bits)
        if not step:
            return lo, left
        buckets = inside.groupBy(F.shiftright(F.col("h"), bits - step).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 4096 rows
        for r in buckets:
            if left < r["n"]:
                break
            left -= r["n"]
        else:
            return 1 << 60, 0
        bits -= step
        lo = r["b"] << bits
        if r["n"] <= BUCKET:
            inside = h.where((F.col("h") >= lo) & (F.col("h") < lo + (1 << bits)))
            for x in inside.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").collect():  # at most BUCKET
                if left < x["n"]:
                    return x["h"], left
                left -= x["n"]


def split_exact(df: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``n`` rows drawn at random, and the rest.

    Rows are drawn by a hash of their content and ``seed``: histograms of hash bits (4,096 counters a
    round) find the hash that bounds the ``n`` smallest, so there is no sort and no global limit, and a
    lost task draws the same rows again. Equal rows have equal hashes; where the bound falls among them, the
    missing ones are taken of those.
    """
    hash_, k = _cutoff(df, n, seed)
    h = _row_hash(df, seed)
    edge = df.where(h == hash_)
    first = df.where(h < hash_)
    if not k:
        return first, df.where(h >= hash_)
    total = edge.count()
    return first.union(edge.limit(k)), df.where(h > hash_).union(edge.limit(total - k))


def sample_exact(df: DataFrame, value: float | int | None, seed: int) -> DataFrame:
    """An int draws that many rows, a float that share (rounded up), None a share that the seed gives."""
    if value is None:
        import random

        value = random.Random(seed).random()
    total = df.count()
    n = min(total, int(value)) if isinstance(value, int) and not isinstance(value, bool) else math.ceil(round(total * float(value), 9))
    if n < 0 or (isinstance(value, float) and value > 1):
        raise ValueError("a sample is a count of at least 0 or a share in [0, 1]")
    return df if n >= total else split_exact(df, n, seed)[0]


def repartition_rows(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Contiguous partitions of the given sizes, in order; rows beyond their sum go to the last."""
    place = free_name("__fw_place", df.columns)
    ends = np.cumsum(np.array(sizes, np.int64))

    @F.pandas_udf("int")
    def target(places: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(ends, places.to_numpy(), "right"), len(ends) - 1).astype("int32"))

    return with_position(df, place).repartitionById(len(sizes), target(F.col(place))).sortWithinPartitions(place).drop(place)


def balanced_sizes(total: int, parts: int) -> list[int]:
    """Sizes that differ by one at most, larger first."""
    return [total // parts + (k < total % parts) for k in range(parts)]
