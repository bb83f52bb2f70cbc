"""Per-key results when a few keys hold most records: counts, aggregates and exact quantiles without gathering a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.plans.scale import BROADCAST_ROWS, cut, free_name

#: Bins a range is cut into in every round of the selection.
BINS = 1024


def _bent(x: Column) -> Column:
    """A monotone bend that brings far values near; the first round bins on it."""
    return F.signum(x) * F.log1p(F.abs(x))


def _bin(v: Column, lo: Column, hi: Column, bent: bool) -> Column:
    a, b, x = (_bent(lo), _bent(hi), _bent(v)) if bent else (lo, hi, v)
    share = F.when(b > a, (x - a) / F.when(b > a, b - a)).otherwise(F.when(v <= lo, F.lit(0.0)).otherwise(F.lit(1.0)))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _with_ranges(rows: DataFrame, keys: Sequence[str], ranges: DataFrame) -> DataFrame:
    """Rows joined (null = null) with their key's ranges: broadcast up to a size, salted shuffle beyond it."""
    other = [f"__fw_o{i}" for i in range(len(keys))]
    small = ranges.select(*[F.col(k).alias(o) for k, o in zip(keys, other)], "__fw_ranges")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), _same(keys, other), "inner").drop(*other)
    salts = 16
    left = rows.withColumn("__fw_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("__fw_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, _same([*keys, "__fw_salt"], [*other, "__fw_salt2"]), "inner").drop(*other, "__fw_salt", "__fw_salt2")


def key_profile(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """One row per key: ``n_rows``, ``row_share``, ``n_values``, ``total``, ``least``, ``most`` and exact quantiles.

    Quantile ``q`` is the value of rank ``ceil(q * n_values)`` (at least 1), as SQL's percentile_disc, in
    the column ``q<100 q>`` (``q50``). Nulls and NaNs are no values; a key without values has null
    quantiles; null keys are keys; repeated rows and ties count as often as they occur; an empty table
    gives an empty result. ``value`` is compared as a double (integers beyond 2^53 are not told apart).

    Counts and sums are map-side aggregates. For the quantiles, every round counts the values of each
    key's current range in ``BINS`` bins, also map-side, keeps the bin that holds the wanted rank and
    narrows the range to the values seen in it, until a range is a single value. So what is shuffled
    is at most keys x quantiles x bins counters a task, whatever the size of a key.
    """
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.when(~F.isnan(F.col(f"`{value}`").cast("double")), F.col(f"`{value}`").cast("double") + F.lit(0.0)).alias("__fw_v"))
    stats = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count("__fw_v").alias("n_values"), F.sum("__fw_v").alias("total"), F.min("__fw_v").alias("least"), F.max("__fw_v").alias("most")))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])).alias("w")
    active = stats.where("n_values > 0").select(*keys, wanted, "n_values", F.col("least").alias("lo"), F.col("most").alias("hi"))
    active = active.select(*keys, F.col("w.i").alias("i"), F.greatest(F.ceil(F.round(F.col("w.q") * F.col("n_values"), 9)), F.lit(1)).cast("long").alias("rank"), "lo", "hi")
    done = [active.where("lo = hi").select(*keys, "i", F.col("lo").alias("x"))]
    active, bent = active.where("lo < hi"), True
    values = rows.where("__fw_v is not null")
    while True:
        ranges = active.groupBy(*keys).agg(F.collect_list(F.struct("i", "rank", "lo", "hi")).alias("__fw_ranges"))  # one entry per quantile
        ranges = cut(ranges)
        if ranges.isEmpty():
            break
        hits = _with_ranges(values, keys, ranges).select(*keys, "__fw_v", F.explode(F.filter("__fw_ranges", lambda r: (F.col("__fw_v") >= r["lo"]) & (F.col("__fw_v") <= r["hi"]))).alias("r"))
        bins = hits.select(*keys, "r.i", "r.rank", _bin(F.col("__fw_v"), F.col("r.lo"), F.col("r.hi"), bent).alias("bin"), "__fw_v").groupBy(*keys, "i", "rank", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("__fw_v").alias("lo"), F.max("__fw_v").alias("hi"))
        upto = Window.partitionBy(*keys, "i").orderBy("bin")
        found = bins.withColumn("upto", F.sum("n").over(upto)).where("upto >= rank and upto - n < rank")
        found = cut(found.select(*keys, "i", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi"))
        done.append(found.where("lo = hi").select(*keys, "i", F.col("lo").alias("x")))
        active, bent = found.where("lo < hi"), False
    names: list[str] = []
    for q in quantiles:
        names.append(free_name(f"q{q * 100:g}".replace(".", "_"), [*keys, *names]))
    exact = reduce(DataFrame.union, done).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])
    other = [f"__fw_o{i}" for i in range(len(keys))]
    exact = exact.select(*[F.col(k).alias(o) for k, o in zip(keys, other)], *names)
    everything = stats.agg(F.sum("n_rows").alias("__fw_all"))
    out = stats.join(exact, _same(keys, other), "left").join(F.broadcast(everything))  # one row
    return out.select(*keys, "n_rows", (F.col("n_rows") / F.col("__fw_all")).alias("row_share"), "n_values", "total", "least", "most", *names)
